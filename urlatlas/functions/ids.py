"""Ids by XXH3, which Spark doesn't have, in Arrow functions of their own, so that those nobody asks for are left out: the
URL's id, and, once for each distinct host of a batch, the host in ASCII form, its registered domain and the domain's id."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .suffixes import Suffixes

SCHEMA = "host string, domain string, domain_id long"


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def xxh3(text: str) -> int:
    import xxhash

    return signed(xxhash.xxh3_64_intdigest(text.encode()))


def ascii_host(host: str) -> str:
    if host.isascii():
        return host
    try:
        return host.encode("idna").decode()
    except UnicodeError:
        return host


def named(suffixes: Suffixes):
    """Host to the struct of SCHEMA; null where the host is."""

    @F.pandas_udf(SCHEMA)
    def run(host: pd.Series) -> pd.DataFrame:
        at, hosts = pd.factorize(host)  # a null is -1, which takes the last place
        hosts = [ascii_host(h) for h in hosts]
        domains = [suffixes.registered(h) for h in hosts]
        take = lambda x, kind: pd.Series([*x, None], dtype=kind).take(at).reset_index(drop=True)
        return pd.DataFrame({"host": take(hosts, object), "domain": take(domains, object), "domain_id": take([xxh3(d) for d in domains], "Int64")})

    return run


def url_id(url: str | Column) -> Column:
    """A URL's id; null for null."""

    @F.pandas_udf("long")
    def run(url: pd.Series) -> pd.Series:
        from xxhash import xxh3_64_intdigest

        return pd.Series([None if u is None else signed(xxh3_64_intdigest(u.encode())) for u in url], dtype="Int64")

    return run(url)


def prefix(domain_id: Column, digits: int = 2) -> Column:
    """First hex digits of the unsigned hash."""
    return F.substring(F.lpad(F.lower(F.hex(domain_id)), 16, "0"), 1, digits)


def prefix_of(domain: str, digits: int = 2) -> str:
    return f"{xxh3(domain) & (1 << 64) - 1:016x}"[:digits]


def shard(index_id: Column, shards: int) -> Column:
    return F.pmod(index_id, F.lit(shards))
