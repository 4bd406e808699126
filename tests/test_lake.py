import pytest
from pyspark.sql import functions as F

from urlatlas import batch, files
from urlatlas.functions import ids, suffixes
from urlatlas.operators import index, ingest
from urlatlas.operators.manifest import IndexVersion, Manifest
from urlatlas.operators.registry import DatasetRegistry
from urlatlas.plans import service
from urlatlas.plans.query import QueryService
from urlatlas.sources import inputs, lake, tables
from urlatlas.streaming.ingest import stream_ingest

FIRST = ["https://alpha-shop.com/cart", "https://alpha-shop.com/list?page=2", "http://www.alpha-shop.com/", "https://beta-news.org/today", "https://gamma-wiki.com/Spark"]
SECOND = ["https://gamma-wiki.com/Hadoop", "https://en.gamma-wiki.com/Arrow", "https://alpha-shop.com/sale", "https://delta-blog.net/2024"]
ALPHA = "alpha-shop.com"


def frame(spark, urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("lake"))
    assert ingest.ingest(spark, frame(spark, FIRST), "one", base) == 0
    assert ingest.ingest(spark, frame(spark, SECOND), "two", base) == 1
    index.build(spark, base)
    return base


def test_lake(spark, base):
    assert {(0, ids.prefix_of(d)) for d in (ALPHA, "beta-news.org", "gamma-wiki.com")} <= set(lake.partitions(spark, base))  # text, even if digits
    assert lake.read(spark, base).count() == 9
    assert lake.read_partition(spark, base, 0, ids.prefix_of(ALPHA)).count() == 3
    with pytest.raises(FileNotFoundError):
        lake.read_partition(spark, base, 7, ids.prefix_of(ALPHA))
    assert lake.storage_stats(spark, base)["partitions"] == 6
    with pytest.raises(ValueError, match="missing required columns"):
        lake.check_schema(frame(spark, FIRST))


def test_listing_by_dataset(spark, tmp_path, monkeypatch):
    """Other folders and files don't count, empty partitions do, and the store isn't asked for each partition."""
    for name in ("dataset_id=17/domain_prefix=3a/part-0.parquet", "dataset_id=17/domain_prefix=3a/other.txt", "dataset_id=17/domain_prefix=5b/part-0.parquet", "dataset_id=17/part-1.parquet",
                 "dataset_id=23/domain_prefix=3a/part-0.parquet/x", "dataset_id=abc/domain_prefix=3a/part-0.parquet", "dataset_id=17/domain_prefix=/part-0.parquet"):
        path = tmp_path / "urls" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * 100)
    asked = []
    one = files.children
    monkeypatch.setattr(files, "children", lambda spark, path: asked.append(path) or one(spark, path))
    base = str(tmp_path)
    assert lake.storage_stats(spark, base) == {"partitions": 3, "files": 2, "bytes": 200, "datasets": {17: {"partitions": 2, "files": 2}, 23: {"partitions": 1, "files": 0}}}
    assert not [p for p in asked if "domain_prefix" in p]
    assert set(lake.files_of(spark, base, 17)) == {f"{base}/urls/dataset_id=17/domain_prefix={p}/part-0.parquet" for p in ("3a", "5b")}
    assert lake.files_of(spark, str(tmp_path / "none"), 17) == {}


def test_queries(spark, base):
    q = QueryService(spark, base)
    assert [(r["dataset_id"], r["urls"]) for r in q.datasets_for_domain(ALPHA).collect()] == [(0, 3), (1, 1)]
    with pytest.raises(ValueError, match="Domain not found"):
        q.datasets_for_domain("www.alpha-shop.com")
    page, following = q.urls_page(ALPHA, 0, 0, 2)
    rest, last = q.urls_page(ALPHA, 0, following, 5)
    assert following == 2 and last is None
    assert {r["url"] for r in page.unionByName(rest).collect()} == set(FIRST[:3])
    assert len(q._rows(ALPHA, 0).inputFiles()) == len(q.postings(ALPHA, 0)) + len(q.table("files").inputFiles())  # only what the postings name
    with pytest.raises(ValueError, match="does not contain domain"):
        q.urls_page("beta-news.org", 1)
    assert q.registered("WWW.Alpha-Shop.com") == ALPHA
    assert [q.domain(k) for k in range(4)] == [ALPHA, "beta-news.org", "delta-blog.net", "gamma-wiki.com"]
    assert q.domain(99) is None and len(q.postings(ALPHA, 0)) == 1
    first = q.urls_after(ALPHA, 0, limit=1).first()
    assert q.urls_after(ALPHA, 0, (first["file_id"], first["row"])).count() == 2


def test_service(spark, base):
    q = QueryService(spark, base)
    assert service.answer(q, "/")[0] == 200
    assert service.answer(q, f"/v1/domain/{ALPHA}")[1]["datasets"][1] == {"dataset_id": 1, "url_count_est": 1}
    assert service.answer(q, "/v1/domain/none.com")[0] == 404
    assert service.answer(q, f"/v1/domain/{ALPHA}/datasets/0/urls?limit=0")[0] == 422
    status, body = service.answer(q, f"/v1/domain/{ALPHA}/datasets/0/urls?offset=1&limit=1")
    assert status == 200 and len(body["items"]) == 1 and body["next_offset"] == 2


def test_incremental(spark, tmp_path):
    base = str(tmp_path)
    ingest.ingest(spark, frame(spark, ["http://middle1.com/", "http://middle2.com/"]), "one", base)
    first = index.build(spark, base, incremental=True)
    assert index.build(spark, base, incremental=True) == first  # nothing new
    ingest.ingest(spark, frame(spark, ["http://aaa-before.com/", "http://zzz-after.com/", "http://middle1.com/x"]), "two", base)
    second = index.build(spark, base, incremental=True)
    got = {r["domain"]: r["domain_id"] for r in index.read_table(spark, base, second, "domains").collect()}
    assert got == {"middle1.com": 0, "middle2.com": 1, "aaa-before.com": 2, "zzz-after.com": 3}
    full = index.build(spark, base)
    by_name = lambda v: {(r["domain"], r["dataset_id"], r["urls"]) for r in index.read_table(spark, base, v, "counts").join(index.read_table(spark, base, v, "domains"), "domain_id").collect()}
    assert by_name(second) == by_name(full)
    assert index.build_stats(spark, base, full, 16) == {"num_domains": 4, "num_files": 5, "num_domain_dataset_pairs": 5, "num_postings_shards": 4}
    m = Manifest(spark, base)
    assert m.keep_last(1) and m.collect() and [v.version for v in Manifest(spark, base).list()] == [full]


def test_empty_lake(spark, tmp_path):
    version = index.build(spark, str(tmp_path))
    assert index.build_stats(spark, str(tmp_path), version, 4)["num_domains"] == 0
    with pytest.raises(ValueError):
        QueryService(spark, str(tmp_path)).datasets_for_domain("a.com")
    with pytest.raises(RuntimeError):
        QueryService(spark, str(tmp_path / "none"))


def test_manifest(spark, tmp_path):
    m = Manifest(spark, str(tmp_path))
    assert m.current() is None
    with pytest.raises(ValueError):
        m.set_current("x")
    m.publish(IndexVersion("b", "2"))
    m.publish(IndexVersion("a", "1"))
    m.add(IndexVersion("a", "1", {"t": "p"}))
    assert [v.version for v in m.list()] == ["a", "b"] and m.keep_last(1) == []


def test_registry(spark, tmp_path):
    r = DatasetRegistry(spark, str(tmp_path))
    assert [r.register(x) for x in ("a", "b", "a")] == [0, 1, 0]
    assert DatasetRegistry(spark, str(tmp_path)).register("c") == 2
    with pytest.raises(ValueError):
        r.register("")
    with pytest.raises(KeyError):
        r.id_of("none")
    r.reset()
    assert r.to_dict() == {}
    (tmp_path / "registry.json").write_text("{broken")
    with pytest.raises(ValueError, match="can't be read"):
        DatasetRegistry(spark, str(tmp_path))


def test_small_files_are_replaced_whole(spark, tmp_path):
    for k in range(3):
        files.write_json(spark, str(tmp_path / "a" / "x.json"), {"k": k})
    assert files.read_json(spark, str(tmp_path / "a" / "x.json")) == {"k": 2}
    assert [p.name for p in (tmp_path / "a").iterdir() if not p.name.endswith(".crc")] == ["x.json"]
    with pytest.raises(FileNotFoundError, match="suffix list"):
        suffixes.load(str(tmp_path / "none"))


def test_incremental_reads_new_files_only(spark, tmp_path):
    base = str(tmp_path)
    ingest.ingest(spark, frame(spark, FIRST), "one", base)
    index.build(spark, base)
    old = set(index.lake_files(spark, base).select("path").toPandas()["path"])
    ingest.ingest(spark, frame(spark, SECOND), "two", base)
    new = index.lake_files(spark, base).where(~F.col("path").isin(list(old)))
    read = index.facts(spark, base, new, by_name=True)
    assert {p[p.index("urls/") :] for p in read.inputFiles()} == {r["path"] for r in new.collect()}
    assert read.agg(F.sum("urls")).first()[0] == len(SECOND)


def test_ingest_counts(spark, tmp_path):
    base = str(tmp_path)
    found = ingest.ingest_counted(spark, frame(spark, [*FIRST, None, "", "x", "http://a.com:99999/", ""]), "one", base)
    assert (found.rows, found.stored) == (10, 5)
    assert found.rejected == {"null": 1, "empty": 2, "no host": 1, "bad port": 1}
    assert found.files == sum(x["files"] for x in lake.storage_stats(spark, base)["datasets"].values()) and found.bytes > 0
    again = ingest.ingest_counted(spark, frame(spark, SECOND), "one", base, mode="overwrite")
    assert (again.rows, again.stored, again.rejected) == (4, 4, {})
    assert lake.read(spark, base).count() == 4
    nothing = ingest.ingest_counted(spark, frame(spark, [None]), "two", base)
    assert (nothing.rows, nothing.stored, nothing.files, nothing.bytes) == (1, 0, 0, 0)


def test_ingest_of_an_empty_table(spark, tmp_path):
    found = ingest.ingest_counted(spark, spark.createDataFrame([], "url string"), "none", str(tmp_path))
    assert (found.rows, found.stored, found.rejected, found.files) == (0, 0, {}, 0)


def test_tsv(spark, tmp_path):
    rows = [(0, "00", "a\tb"), (1, None, 'say "x"\nand'), (2, "3d", "")]
    kind = "file_id int, domain_prefix string, path string"
    assert tables.write_tsv(spark.createDataFrame(rows, kind), str(tmp_path / "t"))
    assert sorted(tuple(r) for r in tables.read_tsv(spark, str(tmp_path / "t"), kind).collect()) == rows
    assert not tables.write_tsv(spark.createDataFrame([], kind), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_lookups_and_stored_top(spark, base):
    q = QueryService(spark, base)
    record = q.file(0)
    assert record[0] == 0 and q.file_id(record[2]) == 0
    assert q.file(99) is None and q.file_id("urls/none") is None
    q.materialise_top(2)
    assert [tuple(r) for r in q.top_urls(ALPHA, 0).orderBy("rank").collect()] == [(u, 1, k + 1) for k, u in enumerate(sorted(FIRST[:3])[:2])]
    acl = spark.createDataFrame([(1, "x")], "dataset_id int, note string")
    assert [(r["dataset_id"], r["urls"]) for r in q.allowed(q.datasets_for_domain(ALPHA), acl).collect()] == [(1, 1)]


def test_inputs(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("url\tdomain\nhttp://a.com/\ta.com\n")
    assert inputs.read_urls(spark, str(tmp_path / "a.tsv")).first()["url"] == "http://a.com/"
    with pytest.raises(ValueError):
        inputs.read_urls(spark, str(tmp_path / "a.txt"))
    (tmp_path / "names").write_text("# all\nuser/one\n\ntwo-x # two\n")
    assert inputs.read_names(spark, str(tmp_path / "names"), "-x") == ["one-x", "two-x"]
    with pytest.raises(ValueError, match="missing"):
        inputs.validate(spark.range(1))


def test_stream_and_batch(spark, tmp_path):
    base, folder = str(tmp_path / "lake"), str(tmp_path / "in")
    frame(spark, FIRST).write.parquet(folder)
    stream_ingest(spark, folder, "s", base, build_index=True).awaitTermination()
    frame(spark, SECOND).write.mode("append").parquet(folder)
    stream_ingest(spark, folder, "s", base, build_index=True).awaitTermination()
    assert lake.read(spark, base).count() == 9
    assert QueryService(spark, base).datasets_for_domain("gamma-wiki.com").first()["urls"] == 3
    frame(spark, SECOND).write.parquet(str(tmp_path / "more.parquet"))
    assert batch.run(spark, ["more", "missing"], str(tmp_path), base)[0] == ["more"]
    assert batch.run(spark, ["more"], str(tmp_path), base) == ([], None)
    assert lake.read(spark, base).where(F.col("dataset_id") == 1).count() == 4
    frame(spark, SECOND[:1]).write.mode("overwrite").parquet(str(tmp_path / "more.parquet"))
    assert batch.run(spark, ["more"], str(tmp_path), base, force=True)[0] == ["more"]
    assert [r["path_query"] for r in lake.read(spark, base).where(F.col("dataset_id") == 1).collect()] == ["/Hadoop"]  # partitions that it had before too
