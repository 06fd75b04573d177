import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexmill.sources import chats, files, records

SCAN = {"tool": "scan", "Results": [{"Target": "a", "Vulnerabilities": [{"id": 1}, {"id": 2}]}, {"Target": "b", "Vulnerabilities": [{"id": 3}]}]}


def test_poor_containers_are_entered():
    got = records.json_records(SCAN)
    assert [(r["@Target"], r["id"], r["@tool"]) for _, r in got] == [("a", 1, "scan"), ("a", 2, "scan"), ("b", 3, "scan")]
    assert got[0][0] == "Results.Vulnerabilities"


def test_rich_containers_are_records():
    alert = {k: k for k in "abcdef"} | {"instances": [{"u": 1}, {"u": 2}]}
    got = records.json_records({"site": [{"name": "s", "alerts": [alert, alert]}]})
    assert len(got) == 2 and got[0][1]["instances"] == "[2 items]" and got[0][1]["@name"] == "s"


def test_other_shapes():
    assert records.json_records({"a": 1, "b": None}) == [("$", {"a": 1, "b": None})]
    assert records.json_records([1, 2, 3]) == [] and records.records_of("x.json", "[1,2,3]") is None
    assert records.records_of("x.jsonl", '{"id": 1}\nbad\n{"id": 2}') == [("line[0]", {"id": 1}), ("line[2]", {"id": 2})]
    deep = node = {}
    for _ in range(30):
        node["x"] = [{}]
        node = node["x"][0]
    assert records.json_records(deep) == []
    assert records.records_of("x.json", "{") is None and records.records_of("x.txt", "a") is None


def test_xml_records():
    xml = "<r><site n='1'><alerts><alertitem k='a'><name>x</name><instances><instance><u>1</u></instance><instance><u>2</u></instance></instances></alertitem><alertitem k='b'><name>y</name></alertitem></alerts></site></r>"
    got = records.xml_records(xml)
    assert [r["name"] for _, r in got] == ["x", "y"] and got[0][1] == {"@k": "a", "name": "x", "instances": "[2 items]"}
    assert records.xml_records("<a><b>1</b></a>") == []


def test_render():
    assert records.render("p", {"a": "x  y", "b": None, "c": "", "d": [1, 2], "e": [{}], "@f": "z" * 200}).split("\n") == ["- record @ p", "  a: x y", "  d: 1, 2", "  e: [1 items]", "  @f: " + "z" * 160 + "…"]


def test_record_rows(spark):
    df = spark.createDataFrame([("a.json", json.dumps(SCAN), "x"), ("b.txt", "hello", "x"), (None, "{}", "x"), ("c.json", None, "x")], "source_path string, text string, record string")
    assert sorted(r.record["id"] for r in records.record_rows(df).collect()) == ["1", "2", "3"]
    assert records.record_rows(df.limit(0)).count() == 0


PHONE = "[01.02.2024, 10:00:01] Ann: hello\nmore\n[01.02.2024, 10:00:02] Bob: hi\n[01.02.2024, 10:00:03] Messages are encrypted\nlost line\n[01.02.2024, 10:00:04] Ann: bye: now\n01/02/2024, 10:05 - Bob: ok"


def test_phone_export():
    assert chats.phone_export(PHONE) == [("Ann", "01.02.2024, 10:00:01", "hello\nmore"), ("Bob", "01.02.2024, 10:00:02", "hi"), ("Ann", "01.02.2024, 10:00:04", "bye: now"), ("Bob", "01/02/2024, 10:05", "ok")]
    assert chats.phone_export("2024-01-01T10:00 ERROR: a\n" * 20) is None


def test_json_chats():
    work = [{"type": "message", "user": "U1", "user_profile": {"real_name": "Ann"}, "text": "hi", "ts": "1700000000.1"}, {"type": "message", "subtype": "channel_join", "text": "joined", "ts": "1"}, {"type": "message", "username": "bot", "text": "yo", "ts": "1700000060"}]
    assert chats.messages("x.json", json.dumps(work)) == ("workspace", [("Ann", "2023-11-14 22:13", "hi"), ("bot", "2023-11-14 22:14", "yo")])
    guild = {"guild": {}, "channel": {}, "messages": [{"author": {"name": "n", "nickname": "Nick"}, "timestamp": "2024-01-02T03:04:05", "content": "c"}, {"content": ""}]}
    assert chats.messages("x.json", json.dumps(guild)) == ("guild", [("Nick", "2024-01-02 03:04", "c")])
    assert chats.messages("x.json", "[]") is None and chats.messages("x.json", "{") is None


def test_messenger_html():
    html = """<div class="message service"><div class="text">joined</div></div><div class="message default"><div class="date" title="01.01.2024 10:00">10:00</div><div class="from_name">Ann</div><div class="text">Hi<br>there</div></div>
    <div class="message default"><div class="reply_to">x</div><div class="text">again</div><div class="media_wrap"></div></div>"""
    assert chats.messages("x.html", html) == ("messenger", [("Ann", "01.01.2024 10:00", "Hi\nthere"), ("Ann", "", "[reply] [media] again")])


def test_named_log():
    log = "Ann: a\nBob: b\nAnn: c\n  more\nBob: d\nAnn: e\nBob: f"
    assert chats.named_log(log)[2] == ("Ann", "", "c\n  more") and chats.named_log("one\ntwo") is None
    assert chats.dialogue([("Ann", "t", "x"), ("Bob", "", "y")]) == "[t] Ann: x\nBob: y"


def test_decode_and_sniff():
    assert files.decode("é".encode()) == "é" and files.decode("Привет".encode("cp1251")) == "Привет" and files.decode("ab".encode("utf-16")) == "ab"
    assert files.is_binary(b"ab\0c") and not files.is_binary("текст".encode("cp1251")) and not files.is_binary(b"")
    assert files.delimiter("a;b;c\n1,2;3") == ";" and files.delimiter("abc") == "\t"


def test_page_text_and_results():
    html = "<html><head><title>T</title><style>x</style></head><body><header>H</header><nav>N</nav><article><h1>A</h1><p>One <b>two</b></p><script>s</script></article><footer>F</footer></body></html>"
    assert files.page_text(html) == ("T", "A\n\nOne two") and files.page_text("<body><p>x<nav>y</nav>") == ("", "x") and files.page_text(None) == ("", "")
    serp = '<a class="result__a" href="//duck.example/l/?uddg=https%3A%2F%2Fa.example%2Fx&amp;r=1">A <b>x</b></a><a class="result__a" href="https://a.example/x">again</a><a href="https://no.example">n</a>'
    assert files.search_results(serp) == [("https://a.example/x", "A x")]


def test_archives_and_reader(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
        z.writestr("../evil.txt", "no")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("page.html", "<body><p>Hi</p></body>")
    got = dict(files.unpack("o.zip", outer.getvalue()))
    assert got == {"o.zip/in.zip/deep.txt": b"deep", "o.zip/page.html": b"<body><p>Hi</p></body>"}
    with pytest.raises(ValueError):
        list(files.unpack("b.gz", gzip.compress(b"0" * 1000), budget=100))
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.txt").write_text("no")
    (tmp_path / "a.zip").write_bytes(outer.getvalue())
    (tmp_path / "b.txt").write_bytes("Привет".encode("cp1251"))
    (tmp_path / "c.bin").write_bytes(b"\0\1")
    (tmp_path / "t.csv").write_text("a;b\n1;x\n2;y\n")
    rows = {r.source_path.rsplit("/", 1)[1]: (r.kind, r.text) for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows == {"deep.txt": ("text", "deep"), "page.html": ("html", "Hi"), "b.txt": ("text", "Привет"), "t.csv": ("table", "a;b\n1;x\n2;y\n")}
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "t.csv")).collect()] == [(1, "x"), (2, "y")]


def test_hidden_folders_above_the_root_and_broken_archives(spark, tmp_path):
    root = tmp_path / ".store" / "docs"
    (root / ".git").mkdir(parents=True)
    (root / "node_modules").mkdir()
    for name, data in (("a.txt", b"kept"), (".git/b.txt", b"x"), ("node_modules/c.txt", b"x"), ("d.bin", b"x"), ("bad.zip", b"PK no zip"), ("e.txt", b"a\0b")):
        (root / name).write_bytes(data)
    with zipfile.ZipFile(root / "good.zip", "w") as z:
        z.writestr("in.txt", "inside")
    got = {r.source_path.rpartition("docs/")[2]: (r.kind, r.text, bool(r.error)) for r in files.read_documents(spark, str(root)).collect()}
    assert got == {"a.txt": ("text", "kept", False), "bad.zip": ("error", None, True), "e.txt": ("binary", None, False), "good.zip/in.txt": ("text", "inside", False)}


def test_tables_and_titles(spark, tmp_path):
    (tmp_path / "t.csv").write_bytes("имя;n\nАня;1\n".encode("cp1251"))
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "t.csv")).collect()] == [("Аня", 1)]
    (tmp_path / "a.json").write_text('[{"a": {"b": 1}, "c": "x"}, {"c": "y"}]')
    (tmp_path / "b.json").write_text('["p", "q"]')
    table = files.read_json_table(spark, str(tmp_path / "a.json"))
    assert table.columns == ["a.b", "c"] and table.count() == 2
    assert [r.value for r in files.read_json_table(spark, str(tmp_path / "b.json")).collect()] == ["p", "q"]
    rows = [("x/a.md", "\n## My title\nmore", "My title", "Markdown"), ("x\\b_c.pdf", None, "b c", "PDF document"), ("p.html", "<html><title>T</title>", "T", "HTML document"), ("q.csv", 'a;"b";;c', "a, b, c", "CSV table"), ("m.py", "#!x\n# A module about mills\n", "A module about mills", "Python source"), ("n.qqq", "z", "n", "QQQ file"), (None, None, "", "file")]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, *_) in enumerate(rows)], "i int, p string, t string")
    got = {r.i: (r.title or "", r.f) for r in df.select("i", files.file_title(F.col("p"), F.col("t")).alias("title"), files.format_name(F.col("p")).alias("f")).collect()}
    assert got == {i: (title, f) for i, (_, _, title, f) in enumerate(rows)}


def test_whole_text_and_namespaces():
    assert files.whole_text("<body><nav>Menu</nav><h1>Head</h1><script>x</script><p>One  two</p></body>") == ("Head", "Menu\nHead\n\nOne two")
    assert files.whole_text(None) == ("", "")
    xml = '<r xmlns="urn:x"><i k="1">own<n>a</n></i><i><n>b</n></i></r>'
    assert records.xml_records(xml) == [("i", {"@k": "1", "n": "a", "#text": "own"}), ("i", {"n": "b"})]
    assert records.records_of("a.jsonl", '{"a": 1}\n{"a": 2}', most_letters=5) is None
