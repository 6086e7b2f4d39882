"""Nested JSON, paths in texts, published runs, knowledge files and images, vectors as bytes: on literal values."""

import base64
import hashlib
import json
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from capsight.functions import nested, paths, vectors
from capsight.operators.knowledge import markdown_sections
from capsight.plans import imports
from capsight.sources import knowledge_files, published
from capsight.sources.published import NotPublished


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()[:8]


def test_leaves_of_nested_and_malformed_json(spark):
    deep = "1"
    for k in range(nested.MOST_DEPTH - 1):
        deep = f'{{"d": {deep}}}' if k % 2 else f"[{deep}]"
    values = {
        "plain": ('{"b": {"y": 1.5, "x": [true, null, "s"]}, "a": "t"}', [("a", "string", "t"), ("b.x[0]", "boolean", "true"), ("b.x[1]", "null", None), ("b.x[2]", "string", "s"), ("b.y", "number", "1.5")]),
        "keys": ('{"API-Key": 1, "my_token": {"a": 2}, "Client": 3, "ok": {"password2": 4, "z": 5}}', [("ok.z", "number", "5")]),
        "items": (json.dumps({"l": list(range(20))}), [(f"l[{n}]", "number", str(n)) for n in range(8)]),
        "local": ('{"f": "see /home/x/y", "g": "C:\\\\logs\\\\a", "h": "/srv/x"}', [("h", "string", "/srv/x")]),
        "bounds": (json.dumps({"k" * 200: {"m": "v" * 200}}), [(("k" * 128 + ".m")[-128:], "string", "v" * 128)]),
        "scalar": ("5", []), "deep": (deep, None), "over": (f"[[{deep}]]", []), "very": ("[" * 100_000 + "]" * 100_000, None),
        "broken": ('{"a": 1', None), "nan": ('{"a": NaN}', None), "empty": ("", None), "null": (None, None), "quote": ('{"a": "é\\u0000"}', [("a", "string", "é\0")]),
    }
    rows = spark.createDataFrame([(k, v) for k, (v, _) in values.items()], "k string, text string")
    found = {r.k: None if r.x is None else [tuple(i) for i in r.x] for r in rows.select("k", nested.flattened(F.col("text")).alias("x")).collect()}
    assert len(found["deep"]) == 1 and found["deep"][0][2] == "1"
    for name, (_, expected) in values.items():
        if name != "deep":
            assert found[name] == expected, name


def test_all_leaves_have_no_bounds(spark):
    def deep(n):
        return '{"d": [' * n + "7" + "]}" * n

    long = {"a": {"k" * 200: {"m": "v" * 200}}, "l": list(range(20)), "x" * 130 + "token": 1, "": {"": None}}
    values = {
        "bounds": (json.dumps(long), [(".", "null", None), ("a." + "k" * 200 + ".m", "string", "v" * 200), *[(f"l[{n}]", "number", str(n)) for n in range(20)]]),
        "deep": (deep(40), [(".".join(["d[0]"] * 40), "number", "7")]), "deeper": (deep(10_000), [(".".join(["d[0]"] * 10_000), "number", "7")]),
        "digits": (f'{{"n": [-{"9" * 5000}, 1.5, true]}}', [("n[0]", "number", "-" + "9" * 5000), ("n[1]", "number", "1.5"), ("n[2]", "boolean", "true")]),
        "hidden": ('[{"client": {"a": 1}, "b": ["/home/x", "y"]}, [[]], {}]', [("[0].b[1]", "string", "y")]), "many": (json.dumps([[0] * 100] * 1000), [(f"[{n}][{m}]", "number", "0") for n in range(1000) for m in range(100)]),
        "scalar": ("5", []), "broken": (deep(10_000)[:-1], []), "nan": ('{"a": NaN}', []), "empty": ("", []), "null": (None, []),
    }
    rows = spark.createDataFrame([(k, v) for k, (v, _) in values.items()], "k string, text string")
    found = {k: [] for k in values}
    for r in nested.all_leaves(rows, "k", "text").collect():
        found[r.k].append((r.path, r.kind, r.value))
    for name, (_, expected) in values.items():
        assert found[name] == expected, name


def test_leaves_come_in_portions():
    texts = [json.dumps({"l": list(range(100_000))}), None, "{broken", '{"a": 1}', json.dumps(["x" * nested.HELD_SIGNS] * 2)]
    found = list(nested._portions(texts))
    assert len(found) == 3 and max(len(some) for some in found) <= nested.HELD_SIGNS // 64
    leaves = [leaf for some in found for leaf in some]
    assert leaves[:100_001] == [*((0, f"l[{n}]", "number", str(n)) for n in range(100_000)), (3, "a", "number", "1")]
    assert [leaf[:3] for leaf in leaves[100_001:]] == [(4, "[0]", "string"), (4, "[1]", "string")]


def test_parsing_without_recursion_equals_json():
    rng = random.Random(5)
    texts = ["", " ", "]", "[1,]", "[,1]", "{,}", '{"a":1,}', '{"a"}', '{"a",1}', "[}", "{]", "nul", "NaN", "[-Infinity]", "01", "1.", "-", '"a', '"\n"', " 1 ", '{"a":1}}', "1]", "[1 2]", '{"a":1 "b":2}']
    sound = json.dumps({"a": [1, -0.0, 1e300, None, {}], "b\"é": {"": [[], True, {"c": "\\\u0000😀"}]}, "n": 10**30})
    for _ in range(3000):
        at = rng.randrange(len(sound))
        texts.append(sound[:at] + rng.choice([*'[]{},:"0 -.eE\\\n', ""]) + sound[at + rng.randrange(2) :])
    for text in texts:
        good, value = nested._loaded(text)
        try:
            assert repr(nested._parsed(text)) == repr(value) and good, text
        except ValueError:
            assert not good, text


def test_nested_features_has_all_items_of_its_lists(spark):
    found = imports.nested_features(spark, "/root/testdata/sf0.001").where("path like 'tags%'").groupBy("event_id").count().select("count").distinct().collect()
    assert found == [(10,)]


def test_redaction_reaches_every_depth(spark):
    text = json.dumps({"note": "a@b.org at 10.1.2.3", "secret": {"x": 1}, "l": [{"token": 1, "p": "/tmp/x y"}, ["token=abc", 5, None, True]]})
    rows = spark.createDataFrame([(text,), ("{",), (None,), ("[1, {}]",)], "t string")
    found = [r.x for r in rows.select(nested.redacted_json(F.col("t")).alias("x")).collect()]
    assert json.loads(found[0]) == {
        "note": f"<EMAIL:{digest('a@b.org')}> at <IP:{digest('10.1.2.3')}>", "l": [{"p": f"<PATH:{digest('/tmp/x')}> y"}, [f"<SECRET:{digest('token=abc')}>", 5, None, True]],
    }
    assert found[1:] == [None, None, "[1,{}]"]


PATHS = {
    "plain": ("open /data/a.pcap now", ["/data/a.pcap"]), "quoted": ("""see '/x/it is.pcapng' and "b c.pcap".""", ["/x/it is.pcapng", "/w/b c.pcap"]),
    "windows": ("C:\\caps\\one two.pcapng, D:/x.pcap;", ["C:\\caps\\one two.pcapng", "D:/x.pcap"]), "relative": ("./a.pcap; ../b.pcap", ["/w/a.pcap", "/b.pcap"]),
    "adjacent": ('"a.pcap""b.pcap"', ["/w/a.pcap", "/w/b.pcap"]), "nested": ('"/data/x/"y.pcap', ["/w/y.pcap"]), "bare": ("文件.pcap，trace.PCAPNG", ["/w/文件.pcap", "/w/trace.PCAPNG"]),
    "twice": ("'a.pcap' 'a.pcap'", ["/w/a.pcap", "/w/a.pcap"]), "none": ("no pcap here. x.pcap2", None), "empty": ("", []), "null": (None, []), "other": ("a.pcapng.gz", None),
}


def test_paths_are_found_by_priority_and_put_back(spark):
    rows = spark.createDataFrame([(k, v) for k, (v, _) in PATHS.items()], "k string, t string")
    found = paths.with_placeholders(rows, "k", "t", "/w").withColumn("back", paths.restored(F.col("t"), F.col("references"))).collect()
    assert len(found) == len(PATHS)
    for r in found:
        text, expected = PATHS[r.k]
        got = [ref.path for ref in r.references]
        if expected is not None:
            assert got == expected, r.k
        if text and got:
            assert "pcap" not in r.t.lower() and all(ref.placeholder == f"capture_{digest(ref.path)}" for ref in r.references)
            assert all(p in r.back for p in got)
        elif not got:
            assert r.t == text
    spans = [(r.k, r.start, r.stop) for r in paths.capture_paths(rows, "t", "/w").collect()]
    for name in PATHS:
        mine = sorted(s[1:] for s in spans if s[0] == name)
        assert all(a[1] <= b[0] for a, b in zip(mine, mine[1:], strict=False))


def test_path_search_equals_the_patterns_and_is_linear():
    rng = random.Random(7)
    bits = ['"', "'", "a.pcap", ".pcapng", ".PCAP", " ", "/", "C:\\", "x", ",", "\n", "../", "。", "é", ".pcap", "-", "_"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert list(paths._quoted(text)) == [m.span("path") for m in paths._PATTERNS[0].finditer(text)], text
        for pattern in paths._PATTERNS[1:]:
            assert list(paths._plain(text, pattern)) == [m.span("path") for m in pattern.finditer(text)], text
    for text in ('"a.pcap ' * 60_000, ".pcap" + "a " * 300_000, "a.pcap," + "/ x" * 200_000, "'" * 500_000 + ".pcap", "C:/" * 200_000 + ",.pcap"):
        began = time.perf_counter()
        paths.spans(text, "/")
        assert time.perf_counter() - began < 10


def test_readers_see_whole_runs_only(spark, tmp_path):
    base = str(tmp_path / "base")
    with pytest.raises(NotPublished):
        published.read(spark, base, "a")
    first = published.publish(base, {"a": spark.range(3), "b": spark.range(2)})
    broken = spark.range(5).select(F.raise_error(F.lit("stopped")).cast("long").alias("id"))
    with pytest.raises(Exception, match="stopped"):
        published.publish(base, {"a": spark.range(9), "b": broken}, "broken")
    assert published.read(spark, base, "a").count() == 3
    with pytest.raises(NotPublished):
        published.read(spark, base, "a", "broken")
    second = published.publish(base, {"a": spark.range(4)})
    assert published.read(spark, base, "a").count() == 4 and published.read(spark, base, "a", first).count() == 3
    with pytest.raises(NotPublished):
        published.read(spark, base, "b")
    with pytest.raises(ValueError, match="written"):
        published.publish(base, {}, second)
    third = published.publish(base, {"a": spark.range(0)})
    assert published.read(spark, base, "a").count() == 0 and published.read(spark, base, "a").columns == ["id"]
    assert set(published.prune(base, 2)) == {first, "broken"}
    assert published.read(spark, base, "a", second).count() == 4 and published.manifest(base)["run"] == third


def test_json_is_whole_or_not_there(tmp_path):
    path = tmp_path / "x" / "a.json"
    published.write_json(str(path), {"é": 1})
    with pytest.raises(TypeError):
        published.write_json(str(path), {"a": object()})
    assert json.loads(path.read_text()) == {"é": 1} and [p.name for p in path.parent.iterdir()] == ["a.json"]


def test_artifacts_are_held_against_their_list(spark, tmp_path):
    (tmp_path / "good").write_bytes(b"abc")
    (tmp_path / "changed").write_bytes(b"abd")
    (tmp_path / "short").write_bytes(b"ab")
    sha = hashlib.sha256(b"abc").hexdigest()
    expected = spark.createDataFrame([(f"file:{tmp_path}/{n}", 3, sha) for n in ("good", "changed", "short", "gone")], "path string, size long, sha256 string")
    found = {r.path.rpartition("/")[2]: (r.fault, r.content and bytes(r.content)) for r in published.verified(knowledge_files.files(spark, str(tmp_path)), expected).collect()}
    assert found == {"good": (None, b"abc"), "changed": ("hash", None), "short": ("size", None), "gone": ("missing", None)}


PNG, JPEG, WEBP = b"\x89PNG\r\n\x1a\n...", b"\xff\xd8\xff...", b"RIFF1234WEBP..."


def test_markdown_with_images(spark, tmp_path):
    folder = tmp_path / "kb"
    (folder / "img").mkdir(parents=True)
    for name, content in {"img/a.png": PNG, "b.JPG": JPEG, "c.webp": WEBP, "wrong.png": JPEG, "empty.png": b"", "d.gif": b"GIF8", "big.png": PNG + b"0" * knowledge_files.MOST_IMAGE}.items():
        (folder / name).write_bytes(content)
    (tmp_path / "up.png").write_bytes(PNG)
    text = (
        "intro a@b.org\n# One\n![the a](img/a.png \"title\") and ![](./b.JPG)![c](img/../c.webp)\n## Two\n![w](wrong.png) ![e](empty.png) ![g](d.gif) ![m](no.png)\n"
        "![u](../up.png) ![in](../kb/img/a.png) ![r](https://x.org/a.png) ![d](data:image/png;base64,AA) ![big](big.png) ![abs](/etc/a.png)\n"
    )
    (folder / "doc.md").write_text(text)
    (folder / "plain.txt").write_text("text")
    (folder / "bad.md").write_bytes(b"\xff\xfe")
    (folder / "none.md").write_bytes(b"")  # the reader leaves out empty files
    (folder / "x.bin").write_bytes(b"1")
    found = knowledge_files.files(spark, str(folder))
    docs = knowledge_files.texts(found)
    kinds = {r.path.rpartition("/")[2]: (r.kind, r.fault) for r in docs.collect()}
    assert {k: v for k, v in kinds.items() if not k.endswith(("png", "JPG", "webp", "gif"))} == {
        "doc.md": ("markdown", None), "plain.txt": ("text", None), "bad.md": ("markdown", "encoding"), "x.bin": (None, "type"),
    }
    markdown = docs.where("kind = 'markdown' and fault is null")
    shown = knowledge_files.images(markdown, found)
    rows = shown.orderBy("place").collect()
    assert [(r.alt, r.fault) for r in rows] == [
        ("the a", None), ("", None), ("c", None), ("w", "content"), ("e", "missing"), ("g", "format"), ("m", "missing"), ("u", "outside"), ("in", None), ("r", "remote"), ("d", "remote"), ("big", "size"), ("abs", "outside"),
    ]
    assert rows[0].data_url == "data:image/png;base64," + base64.b64encode(PNG).decode() and rows[0].sha256 == hashlib.sha256(PNG).hexdigest() and rows[1].mime == "image/jpeg"
    whole = knowledge_files.rendered(markdown, shown)
    sections = {tuple(r.heading_path): r.body for r in markdown_sections(whole, "path", "text").collect()}
    assert sections == {
        (): f"intro <EMAIL:{digest('a@b.org')}>", ("One",): "[图片：the a；来源：img/a.png] and [图片：b.JPG；来源：b.JPG][图片：c；来源：c.webp]",
        ("One", "Two"): "[图片引用：w] [图片引用：e] [图片引用：g] [图片引用：m]\n[图片引用：u] [图片：in；来源：img/a.png] [图片引用：r] [图片引用：d] [图片引用：big] [图片引用：abs]",
    }


def test_vectors_as_bytes(spark):
    rng = random.Random(1)
    rows = [(k, [struct.unpack("<f", struct.pack("<f", rng.gauss(0, 9)))[0] for _ in range(rng.randrange(5))]) for k in range(50)] + [(50, None), (51, [float("inf"), -0.0])]
    frame = spark.createDataFrame(rows, "k int, v array<float>").repartition(3)
    found = frame.select("k", "v", vectors.encoded(F.col("v")).alias("b")).withColumn("back", vectors.decoded(F.col("b"))).collect()
    for r in found:
        expected = None if r.v is None else struct.pack(f"<{len(r.v)}f", *r.v)
        assert (r.b if r.b is None else bytes(r.b)) == expected and r.back == r.v
    blobs = spark.createDataFrame([(1, b"123"), (2, b"\0\0\x80?\0\0\0@"), (3, b""), (4, None), (5, b"12345"), (6, b"\0\0\x80?")], "k int, b binary").coalesce(1)
    got = {r.k: (r.x, r.y) for r in blobs.select("k", vectors.decoded(F.col("b")).alias("x"), vectors.decoded(F.col("b"), 2).alias("y")).collect()}
    assert got == {1: (None, None), 2: ([1.0, 2.0], [1.0, 2.0]), 3: ([], None), 4: (None, None), 5: (None, None), 6: ([1.0], None)}
