"""Which datasets contain a web domain, and which of its URLs they hold, as Spark plans over very large URL collections."""
