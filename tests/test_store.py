import threading

import pytest
from pyspark.sql import functions as F

from lakeshelf.errors import ClosedError, NotFoundError, ValidationError
from lakeshelf.operators.select import iterate, matched, select_page, Query
from lakeshelf.store import Shelf

SEED = [
    ("a", b"x" * 100, {"name": "beach-morning.jpg", "tags": ["Trip", "sea"], "folder": "/photos/2024", "favorite": True, "created_at": 1000, "metadata": {"camera": {"maker": "Foo"}, "iso": 100}}),
    ("b", b"y" * 250, {"name": "beach-evening.jpg", "tags": ["trip"], "folder": "/photos/2023", "notes": "golden hour", "created_at": 2000, "metadata": {"iso": [1, 2]}}),
    ("c", "# Trip notes about the beach", {"name": "notes.md", "folder": "/docs", "created_at": 3000}),
    ("d", b"z" * 400, {"name": "report 10.pdf", "folder": "/docs/work", "created_at": 4000, "metadata": {"n": None}}),
    ("e", b"w" * 50, {"name": "report 9.pdf", "folder": "/docs-old", "created_at": 5000}),
]


@pytest.fixture(scope="module")
def shelf(spark, tmp_path_factory):
    made = Shelf(spark, str(tmp_path_factory.mktemp("shelf")), chunk_size=64).open()
    for id_, data, options in SEED:
        made.add(data, id=id_, **options)
    return made


def names(page):
    return [r["name"] for r in page.items]


def ids(files, where):
    return sorted(r.id for r in matched(files, where, None)[0].select("id").collect())


def test_filters(shelf):
    files = shelf.files().cache()
    cases = [
        ({"id": "a"}, "a"),
        ({"id": []}, ""),
        ({"kind": ["image", "text"]}, "abc"),
        ({"name": "NOTES.md"}, "c"),
        ({"name": {"contains": "REPORT", "notIn": ["report 9.pdf"]}}, "d"),
        ({"name": {"notIn": []}}, "abcde"),
        ({"name": {"regex": "^report \\d+"}}, "de"),
        ({"size": {"gt": 50, "gte": 10, "lt": 400}}, "ab"),
        ({"size": {"between": [50, 100], "ne": 100}}, "e"),
        ({"size": {"gt": 10, "lt": 5}}, ""),
        ({"createdAt": {"gte": 2000, "lt": 4000}}, "bc"),
        ({"folder": {"startsWith": "docs"}}, "cd"),
        ({"folder": ["/docs", "/photos//2024"]}, "ac"),
        ({"tags": ["TRIP"]}, "ab"),
        ({"tags": {"any": []}}, "abcde"),
        ({"tags": {"any": ["sea"], "none": ["x"]}}, "a"),
        ({"tags": {"none": ["trip"]}}, "cde"),
        ({"favorite": False}, "bcde"),
        ({"metadata": {"camera": {"maker": "Foo"}}}, "a"),
        ({"metadata": {"camera.maker": ["Bar", "Foo"]}}, "a"),
        ({"metadata": {"iso": 100}}, "a"),
        ({"metadata": {"iso.1": 2}}, "b"),
        ({"metadata": {"n": None}}, "d"),
        ({"metadata": {"iso": []}}, ""),
        ({"metadataContains": {"camera.maker": "fo"}}, "a"),
        ({"custom": lambda r: r["size"] == 50}, "e"),
    ]
    for where, want in cases:
        assert ids(files, where) == list(want), where
    with pytest.raises(ValidationError):
        matched(files, {"nonsense": 1}, None)


def test_golden_search_scores(shelf):
    def scores(search):
        rows, _ = matched(shelf.files(), None, search)
        return {r.id: r.score for r in rows.select("id", "score").collect()}

    assert scores("beach") == {"a": 12.0, "b": 12.0, "c": 2.0}
    assert scores({"text": "bech", "fuzzy": True}) == {"a": 12 * 0.35, "b": 12 * 0.35, "c": 2 * 0.35}
    assert scores("beach morning") == {"a": 24.0}
    assert scores("golden hour") == {"b": 14.0}
    assert scores({"text": "golden morning", "mode": "any", "boost": 2}) == {"a": 24.0, "b": 8.0}
    assert scores({"text": "beach", "fields": ["text"]}) == {"c": 2.0}
    assert not scores("beach nothing")
    assert matched(shelf.files(), None, "  ")[1] is False


def test_order_and_pages(shelf):
    assert names(shelf.list()) == ["report 9.pdf", "report 10.pdf", "notes.md", "beach-evening.jpg", "beach-morning.jpg"]
    assert names(shelf.list(sort="name")) == ["beach-evening.jpg", "beach-morning.jpg", "notes.md", "report 9.pdf", "report 10.pdf"]
    page = shelf.list(sort={"field": "size"}, limit=2)
    assert page.total == 5 and page.has_more
    seen = names(page)
    while page.next_cursor:
        page = shelf.list(sort={"field": "size"}, limit=2, cursor=page.next_cursor)
        seen += names(page)
    assert len(seen) == len(set(seen)) == 5
    assert names(shelf.list(search="report", limit=1)) == ["report 9.pdf"]
    second = shelf.list(search="beach", limit=2)
    assert names(shelf.list(search="beach", limit=2, cursor=second.next_cursor)) == ["notes.md"]
    assert not shelf.list(limit=0).has_more and names(shelf.list(limit=0)) == []
    for bad in ({"limit": -1}, {"offset": float("nan")}, {"cursor": "?"}, {"sort": "nope"}):
        with pytest.raises(ValidationError):
            shelf.list(**bad)
    assert shelf.first(sort="name")["name"] == "beach-evening.jpg" and shelf.count(where={"kind": "image"}) == 2
    assert shelf.all(where={"kind": "image"}).count() == 2


def test_top_k_is_a_top_k(shelf):
    plan = select_page(shelf.files(), Query(limit=3)).rows._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_extras_and_bytes(shelf):
    item = shelf.list(where={"id": "b"}, include_blob=True, include_text=True).items[0]
    assert bytes(item["blob"]) == b"y" * 250 and item["text"] == ""
    assert shelf.get_blob("c") == SEED[2][1].encode() and shelf.get_text("c").startswith("# Trip")
    assert shelf.read_range("b", 60, 130) == b"y" * 70 and shelf.read_range("b", 240, 999) == b"y" * 10 and shelf.read_range("b", 250, 260) == b""
    with pytest.raises(ValidationError):
        shelf.read_range("b", -1, 5)
    with pytest.raises(NotFoundError):
        shelf.get("nope")


def test_facets_and_stats(shelf):
    facets = shelf.facets()
    assert facets["count"] == 5 and facets["kind"] == {"image": 2, "text": 1, "document": 2} and facets["tag"] == {"Trip": 1, "sea": 1, "trip": 1}
    stats = shelf.stats()
    assert stats["count"] == 5 and stats["size"] == stats["physical_size"] == 828 and stats["by_kind"]["document"]["count"] == 2


def test_iterate_stops(shelf):
    stop, seen = threading.Event(), []
    for row in iterate(shelf.files(), sort="name", signal=stop):
        seen.append(row["name"])
        stop.set()
    assert seen == ["beach-evening.jpg"]


def test_life_of_a_record(spark, tmp_path):
    shelf = Shelf(spark, str(tmp_path / "s"), chunk_size=64)
    with pytest.raises(ClosedError):
        shelf.count()
    shelf.open()
    heard = []
    for event in ("add", "update", "delete", "restore", "purge", "duplicate", "change"):
        shelf.on(event, lambda p, e=event: heard.append(e))
    shelf.on("add", lambda p: 1 / 0)
    one = shelf.add(b"same bytes", name="one.bin", id="1")
    two = shelf.add(b"same bytes", name="two.bin", id="2")
    assert one["hash"] == two["hash"] and shelf.stats()["shared_bytes"] == 10 == shelf.stats()["physical_size"]
    assert shelf.add(b"same bytes", dedupe=True)["id"] == "1"
    with pytest.raises(ValidationError):
        shelf.add(b"", id="1")
    assert shelf.update("1", name="uno.txt", tags=["A", "a"])["revision"] == 2
    assert shelf.set_tags("1", add=["new"], remove=["A"])["tags"] == ["new"]
    assert shelf.update_many(["1", "missing"], notes="n")[0]["notes"] == "n"
    assert shelf.update("2", data=b"other")["size"] == 5 and shelf.get_blob("2") == b"other" and shelf.get_blob("1") == b"same bytes"
    shelf.trash(["1"])
    assert not shelf.has("1") and shelf.get("1")["deleted"] and shelf.count() == 1
    shelf.restore(["1"])
    assert shelf.has("1")
    shelf.trash(["1"])
    assert shelf.empty_trash() == 1 and shelf.find("1") is None and shelf.stats()["physical_size"] == 5
    assert heard[:4] == ["add", "change", "add", "change"] and heard[4] == "duplicate" and "purge" not in heard
    assert shelf.purge(["2", "2"]) == 1 and shelf.chunks().count() == 0 and "purge" in heard
    again = shelf.add(b"other", id="3")
    assert shelf.get_blob("3") == b"other" and again["revision"] == 1
    shelf.compact()
    assert shelf.get_blob("3") == b"other" and shelf.count() == 1
    with pytest.raises(RuntimeError):
        shelf.transaction(lambda s: (s.trash(["3"]), (_ for _ in ()).throw(RuntimeError())))
    assert shelf.has("3")
    shelf.clear()
    assert shelf.count() == 0


def test_backup_import_feed(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.txt").write_text("alpha")
    (tmp_path / "in/sub/b.md").write_text("beta")
    shelf = Shelf(spark, str(tmp_path / "s")).open()
    assert shelf.import_files(str(tmp_path / "in"), folder="up") == 2
    assert {r["folder"] for r in shelf.all().collect()} == {"/up", "/up/sub"}
    assert shelf.count(search="beta") == 1
    first = shelf.first(sort="name")["id"]
    shelf.trash([first])
    assert shelf.backup(str(tmp_path / "backup")) == 2
    other = Shelf(spark, str(tmp_path / "t")).open()
    assert other.restore_backup(str(tmp_path / "backup")) == 2 and other.count() == 1 and other.get_blob(first) == b"alpha"
    assert other.snapshot().count() == 2
    reader = Shelf(spark, str(tmp_path / "s")).open()
    heard = []
    reader.on("change", heard.append)
    reader.sync(str(tmp_path / "checkpoint"))
    assert [c["type"] for c in heard] == ["add", "add", "delete"] and all(c["remote"] for c in heard)
    assert shelf.export_file(first, str(tmp_path)).endswith("a.txt")
    assert shelf.prune_orphans() == {"chunks": 0, "thumbnails": 0}


def test_state_survives_and_versions_are_checked(spark, tmp_path):
    import json

    shelf = Shelf(spark, str(tmp_path / "s")).open()
    shelf.add("one", id="a")
    shelf.compact()
    shelf.add("two", id="b")
    names = [p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("_shelf")]
    assert names and all(json.loads((tmp_path / "s" / n).read_text())["epoch"] <= 1 for n in names)
    assert {r.id for r in Shelf(spark, str(tmp_path / "s")).open().files().collect()} == {"a", "b"}
    (tmp_path / "s" / "_shelf-000000999999.json").write_text(json.dumps({"version": 99, "epoch": 1}))
    with pytest.raises(ValidationError):
        Shelf(spark, str(tmp_path / "s")).open()


def test_a_failed_transaction_keeps_contents(spark, tmp_path):
    shelf = Shelf(spark, str(tmp_path / "s")).open()
    shelf.add("kept", id="a")
    shelf.compact()
    shelf.add("kept too", id="b")

    def body(s):
        s.purge(["a", "b"])
        s.add("inside", id="c")
        raise KeyError

    with pytest.raises(KeyError):
        shelf.transaction(body)
    assert shelf.get_blob("a") == b"kept" and shelf.get_blob("b") == b"kept too" and not shelf.has("c")
    shelf.add("inside", id="c")
    assert shelf.get_blob("c") == b"inside"


def test_batches(spark, tmp_path):
    shelf = Shelf(spark, str(tmp_path / "s")).open()
    got = shelf.add_many(["x", "y", "x"], dedupe=True)
    assert got[0]["id"] == got[2]["id"] != got[1]["id"] and shelf.count() == 2
    raw = spark.createDataFrame([("i", "n", bytearray(b"1")), ("i", "m", bytearray(b"2"))], "id string, name string, content binary")
    with pytest.raises(ValidationError):
        shelf.ingest(raw)
    shelf.set_thumbnail(got[0]["id"], b"t", 1, 1)
    shelf.purge([got[0]["id"]])
    assert shelf.get_thumbnail(got[0]["id"]) is None and shelf.count() == 1


def test_filters_of_a_compacted_shelf_reach_the_scan(spark, tmp_path):
    shelf = Shelf(spark, str(tmp_path / "s")).open()
    shelf.add_many(["x", "y"], folder="/docs")
    shelf.compact()
    shelf.add("z", folder="/docs")
    rows = shelf.list(where={"folder": {"startsWith": "/docs"}, "size": {"gt": 0}}).rows
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(size,0)" in plan and "EqualTo(deleted_at,0)" in plan and "StringStartsWith(folder,/docs/)" in plan
    assert rows.count() == 3


def test_image_sizes(spark):
    import struct

    from lakeshelf.functions.images import image_size, image_size_columns
    from pyspark.sql import functions as F

    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 70_000)
    gif, bmp = b"GIF89a" + struct.pack("<HH", 3, 500), b"BM" + bytes(16) + struct.pack("<ii", 9, -8)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 20, 30)
    cases = [png, gif, bmp, png[:20], b"", b"GIF89a"]
    assert [image_size(c) for c in [*cases, jpeg]] == [(640, 70_000), (3, 500), (9, 8), (None, None), (None, None), (None, None), (30, 20)]
    df = spark.createDataFrame([(bytearray(c),) for c in cases], "c binary")
    assert [tuple(r) for r in df.select(*image_size_columns(F.col("c"), F.lit("image/png"))).collect()] == [image_size(c) for c in cases]


def test_natural_order_of_long_numbers(spark):
    from lakeshelf.operators.sorting import natural_key
    from pyspark.sql import functions as F

    names = ["f" + "9" * 40, "f1" + "0" * 40, "f2", "f10", "F02b", "f"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(natural_key(F.col("n")))
    assert [r.n for r in df.collect()] == ["f", "f2", "F02b", "f10", "f" + "9" * 40, "f1" + "0" * 40]


def _moved(spark, run):
    """Bytes that were shuffled as run ran."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    store = sc._jsc.sc().statusStore()

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = total()
    run()
    return total() - before


def _noise(spark, path, first=0):
    """60 payloads of 16,000 letters each that no compression makes much smaller; every fifth is a copy."""
    import hashlib

    def letters(k):
        return "".join(hashlib.sha512(b"%d %d" % (k, i)).hexdigest() for i in range(125))

    rows = [(f"{k:06d}", f"{k}.txt", bytearray(letters(k - (k % 5 == 4)).encode()), f"/f{k % 2}") for k in range(first, first + 60)]
    spark.createDataFrame(rows, "id string, name string, content binary, folder string").write.parquet(path)
    return spark.read.parquet(path)


def test_changes_and_reads_shuffle_no_texts(spark, tmp_path):
    shelf = Shelf(spark, str(tmp_path / "s")).open()
    odd = lambda: [r.id for r in shelf.all(where={"folder": "/f1"}).select("id").collect()]
    first, second = _noise(spark, str(tmp_path / "1")), _noise(spark, str(tmp_path / "2"), 60)
    read = lambda: shelf.files().write.format("noop").mode("overwrite").save()

    def failing(s):
        s.purge(odd())
        s.move([f"{0:06d}"], "/elsewhere")
        raise KeyError

    def rolled_back():
        with pytest.raises(KeyError):
            shelf.transaction(failing)

    steps = {
        "ingest": lambda: shelf.ingest(first),
        "ingest with dedupe": lambda: shelf.ingest(second, True),
        "read": read,
        "move": lambda: shelf.move(odd(), "/f1"),
        "trash": lambda: shelf.trash(odd()),
        "restore": lambda: shelf.restore([r.id for r in shelf.all(where={"deleted": True}).select("id").collect()]),
        "roll back": rolled_back,
        "compact": shelf.compact,
        "purge": lambda: shelf.purge(odd()),
        "trash again": lambda: shelf.trash([f"{0:06d}", f"{2:06d}"]),
        "empty the trash": shelf.empty_trash,
        "prune": shelf.prune_orphans,
        "read again": read,
        "chunks": lambda: shelf.chunks().write.format("noop").mode("overwrite").save(),
    }
    few = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of many ids
    try:
        moved = {name: _moved(spark, run) for name, run in steps.items()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", few)
    assert max(moved.values()) < 300_000, moved  # the texts are 2 MB, their folded form as much
    assert {r.folder for r in shelf.files().collect()} == {"/f0"} and shelf.get_blob(f"{8:06d}") == shelf.get_text(f"{8:06d}").encode()
    assert _moved(spark, lambda: shelf.backup(str(tmp_path / "b"))) > 300_000  # which brings texts to their bytes


def test_a_backup_leaves_out_what_is_made_anew(spark, tmp_path):
    from lakeshelf.schema import SEARCH_COLUMNS

    shelf = Shelf(spark, str(tmp_path / "s")).open()
    shelf.add_many(["Ärger  im Büro", "two"], tags=["Ä"], notes="Señor", metadata={"n": 1})
    shelf.trash([shelf.first(search="two")["id"]])
    assert shelf.backup(str(tmp_path / "b")) == 2
    assert not set(spark.read.parquet(str(tmp_path / "b")).columns) & set(SEARCH_COLUMNS)
    other = Shelf(spark, str(tmp_path / "t")).open()
    assert other.restore_backup(str(tmp_path / "b")) == 2
    both = [sorted(s.files().select("id", *SEARCH_COLUMNS, F.col("deleted_at") > 0).collect()) for s in (shelf, other)]
    assert both[0] == both[1]


def test_a_walk_gives_the_pages_of_the_cursors(spark, tmp_path):
    shelf = Shelf(spark, str(tmp_path / "s")).open()
    shelf.add_many(["x " * (k % 7 + 1) for k in range(13)])
    shelf.compact()
    shelf.add("a later one")
    for query in ({"sort": "size"}, {"sort": [{"field": "size", "order": "desc"}], "offset": 3}, {"search": "x"}):
        walk, cursor = shelf.walk(limit=5, **query), None
        for number in range(walk.pages):
            page = shelf.list(limit=5, **query) if number == 0 else shelf.list(limit=5, **{**query, "cursor": cursor})
            assert [r.id for r in page.items] == [r.id for r in walk.page(number).collect()]
            cursor = walk.next_cursor(number)
            assert cursor == page.next_cursor
        assert cursor is None and walk.total == page.total - query.get("offset", 0)


def test_the_walk_of_all_pages_takes_as_many_jobs_for_more_pages(spark, tmp_path):
    import os

    from lakeshelf.plans import shelves

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    store = spark.sparkContext._jsc.sc().statusStore()
    counts = []
    for times in (2, 12):  # 400 and 2,400 documents
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("text", F.substring("text", 1, 50))
        docs = docs.crossJoin(spark.range(times).withColumnRenamed("id", "k")).withColumn("doc_id", F.col("doc_id") + 1000 * F.col("k")).drop("k")
        docs.write.parquet(f"{tmp_path}/{times}/documents.parquet")
        before = store.jobsList(spark._jvm.java.util.ArrayList()).size()
        got = shelves.QUERIES["shelf_cursor_pages"][0](spark, f"{tmp_path}/{times}").orderBy("place").collect()
        counts.append(store.jobsList(spark._jvm.java.util.ArrayList()).size() - before)
        assert [r.place for r in got] == list(range(200 * times)) and {(r.total, r.more) for r in got} == {(200 * times, times > 2)}
    assert counts[1] <= counts[0] + 3, counts
