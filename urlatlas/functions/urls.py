"""URL canonicalisation as Column expressions: they stay in the JVM and need no UDF but for hosts outside ASCII.

`parse` works in steps, each of which cuts what the one before it has made. A step is a generator of one row: the optimiser
neither inlines it into the next one nor pushes a filter below it, so that every expression is evaluated once for each URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the URL rules.
DEFAULT_PORTS = {"http": 80, "https": 443, "ftp": 21, "ftps": 990}
SCHEMES_WITH_PARAMETERS = ("", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "sip", "sips", "mms", "sftp", "tel")

#: What may stand around a URL, and what a URL that has it begins or ends with.
_AROUND = r"^[\x00-\x20\x85\p{Z}]+|[\x09-\x0D\x1C-\x20\x85\p{Z}]+$"
_IP_LITERAL = r"^\[([0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*(?:%[^\]]*)?|v[0-9A-Fa-f]+\.[^\]]+)\](?::[0-9]*)?$"


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _after(text: Column, mark: str) -> Column:
    """What follows the first mark; empty without one."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text))).otherwise("")


def parse(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds reject_reason (null for a URL that can be stored) and, null for others, scheme, host, port, path, query and
    path_query. The host isn't yet in ASCII form; the scheme's own port is null."""
    u, c = F.col(url), F.col
    trimmed = F.when(u.rlike(_AROUND), F.regexp_replace(u, _AROUND, "")).otherwise(u)
    df = _step(df, _clean=F.substring_index(F.translate(trimmed, "\t\r\n", ""), "#", 1))
    df = _step(df, _front=F.substring_index("_clean", "?", 1), _query=_after(c("_clean"), "?"))
    df = _step(df, _scheme=F.substring_index("_front", "//", 1), _rest=_after(c("_front"), "//"))
    named = c("_scheme").rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?$") & c("_front").contains("//")
    df = _step(df, _named=named, _authority=F.when(named, F.substring_index("_rest", "/", 1)).otherwise(""))
    path_ = F.when(c("_named"), F.substring(c("_rest"), F.length("_authority") + 1, F.length("_rest"))).otherwise("")
    df = _step(df, _at=F.substring_index("_authority", "@", -1), _path=path_)
    bracket = c("_at").contains("[") | c("_at").contains("]")
    df = _step(
        df,
        _scheme_name=F.lower(F.when(~c("_named") | (c("_scheme") == ""), "http").otherwise(F.substring_index("_scheme", ":", 1))),
        _host=F.lower(F.nullif(F.when(bracket, F.regexp_extract("_at", _IP_LITERAL, 1)).otherwise(F.substring_index("_at", ":", 1)), F.lit(""))),
        _port=F.when(bracket, F.regexp_extract("_at", r"^\[[^\]]*\]:(.*)$", 1)).otherwise(_after(c("_at"), ":")),
    )
    valid = (c("_port") == "") | (c("_port").rlike("^[0-9]+$") & F.coalesce(c("_port").try_cast("decimal(38,0)") <= 65535, F.lit(False)))
    reason = F.when(u.isNull(), "null").when(u == "", "empty").when(c("_host").isNull(), "no host").when(~valid, "bad port")
    df = _step(df, reject_reason=reason)
    ok = c("reject_reason").isNull()
    number = F.nullif(c("_port"), F.lit("")).try_cast("int")
    own = F.lit(False)
    for name, default in DEFAULT_PORTS.items():
        own = own | ((c("_scheme_name") == name) & (number == default))
    cut = F.when(c("_path").contains(";") & c("_scheme_name").isin(*SCHEMES_WITH_PARAMETERS), F.regexp_replace("_path", r";[^/]*$", "")).otherwise(c("_path"))
    bare = F.when(c("_query").contains("%"), F.regexp_replace("_query", r"%(?![0-9A-Fa-f]{2})", "%25")).otherwise(c("_query"))
    df = _step(df, scheme=F.when(ok, c("_scheme_name")), host=F.when(ok, c("_host")), port=F.when(ok & ~F.coalesce(own, F.lit(False)), number), _cut=F.when(ok, cut), _bare=F.when(ok, bare))
    df = _step(df, path=_folded(c("_cut")), query=_sorted(c("_bare")))
    df = df.withColumn("path_query", path_query(c("path"), c("query")))
    return df.drop("_clean", "_front", "_query", "_scheme", "_rest", "_named", "_authority", "_path", "_at", "_scheme_name", "_host", "_port", "_cut", "_bare")


def _folded(cut: Column) -> Column:
    """A path with dot segments and empty segments resolved. Most paths have nothing to resolve and skip the fold."""
    kept = F.aggregate(
        F.filter(F.split(cut, "/"), lambda s: ~s.isin("", ".")), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    folded = F.concat(F.lit("/"), F.array_join(kept, "/"))
    folded = F.when(cut.endswith("/") & (folded != "/"), F.concat(folded, F.lit("/"))).otherwise(folded)
    return F.when(cut == "", "/").when(~(cut.contains("//") | cut.contains("/.")), cut).otherwise(folded)


def _decode(text: Column) -> Column:
    return F.try_url_decode(text)


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _sorted(text: Column) -> Column:
    """A query's pairs in the stable order of their decoded keys, encoded anew."""
    pairs = F.transform(F.filter(F.split(text, "&"), lambda p: p != ""), lambda p, i: F.struct(
        _decode(F.substring_index(p, "=", 1)).alias("k"), i.alias("i"), _decode(_after(p, "=")).alias("v")))
    return F.when(text == "", "").otherwise(F.array_join(F.transform(F.array_sort(pairs), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&"))


def path_query(path_: Column, query_: Column) -> Column:
    return F.when(query_ == "", path_).otherwise(F.concat(path_, F.lit("?"), query_))


def canonical(scheme_: Column, host: Column, port_: Column, path_: Column, query_: Column) -> Column:
    return F.concat(scheme_, F.lit("://"), host, F.when(port_.isNull(), "").otherwise(F.concat(F.lit(":"), port_.cast("string"))), path_query(path_, query_))


def rebuilt(scheme_: Column, host: Column, path_query_: Column) -> Column:
    """From the stored columns; a blank scheme reads as https, and ports are not stored."""
    return F.concat(F.coalesce(F.nullif(scheme_, F.lit("")), F.lit("https")), F.lit("://"), host, path_query_)

