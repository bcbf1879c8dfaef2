"""Objects, tries, HTML, parsers, archives, dumps, folders, scalars."""

import hashlib
import lzma
import struct
import subprocess

import pytest
from pyspark.sql import functions as F

from tidemark.functions import html as H
from tidemark.functions import parsec as P
from tidemark.functions import scalars as X
from tidemark.operators import objects
from tidemark.plans.model import InvalidFile, InvalidInput, KeyNotFound, excluded, included
from tidemark.sources import dump, folders, zim


def test_store(spark, tmp_path):
    s = objects.Store.create(spark).insert(spark, "a/b/c.txt", b"one", "first", "me", 1)
    s = s.transaction().insert("a/d", b"two").insert("z", b"").remove("a/d").insert("a/d", b"three").commit(spark, "second", "me", 2)
    assert len(s) == 3 and s.get("a/d") == b"three"
    with pytest.raises(KeyNotFound):
        s.get("a")
    assert ["/".join(r["path"]) for r in s.scan().collect()] == ["a/b/c.txt", "a/d", "z"]
    assert ["/".join(r["path"]) for r in s.scan(included(["a", "d"]), excluded(["z"]), reverse=True).collect()] == ["a/d"]
    assert [r["depth"] for r in s.ancestors(spark).orderBy("depth").collect()] == [0, 1]
    with pytest.raises(InvalidInput):
        s.insert(spark, "a/d/e", b"")
    assert s.checkout(str(tmp_path)) == 3
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    subprocess.run(["git", "-C", str(tmp_path), "add", "-A"], check=True)
    tree = subprocess.run(["git", "-C", str(tmp_path), "write-tree"], capture_output=True, text=True, check=True).stdout.strip()
    assert s.commits.where(F.col("oid") == s.head).first()["tree_oid"] == tree
    assert len(s.remove(spark, "z")) == 2


def test_trie(spark):
    rows = spark.createDataFrame([(["a"], 1), (["a", "b", "c"], 2), (["a", "d"], 3), (["b"], 4)], "path array<string>, value int")
    got = [(tuple(r["path"]), r["depth"], r["breadth"], r["value"]) for r in objects.trie_walk(rows).collect()]
    assert got == [(("a",), 1, 0, 1), (("a", "b"), 2, 0, None), (("a", "b", "c"), 3, 0, 2), (("a", "d"), 2, 1, 3), (("b",), 1, 1, 4)]
    cut = spark.createDataFrame([(["a", "b"],)], "path array<string>")
    assert objects.trie_walk(rows, cut).count() == 4
    assert objects.trie_get(objects.trie_set(rows, rows.where("value = 1").withColumn("value", F.lit(9))), ["a"]).first()["value"] == 9
    assert objects.trie_remove(rows, cut).count() == 4
    assert objects.excluded(rows, cut).count() == 3


def test_html():
    page = "<!DOCTYPE html><body><div id=a class='x y'><p>1<br/>2<!-- no --></p><p lang=en-US>3</p></div></i><a href=/q disabled>z<script>s()</script></body>"
    nodes = H.parse(page)
    assert [e.kind for e in nodes][:4] == ["doc", "doctype", "tag", "tag"]
    assert H.lines(page) == ["1", "2", "3", "z"]
    pick = lambda css: [(e.tag, H.content(e)) for e in H.select(page, css)]
    assert pick("div.x > p") == [("p", "12"), ("p", "3")]
    assert pick("p + p, a[href^='/']")[0] == ("p", "3") and len(pick("p + p, a[href^='/']")) == 2
    assert pick("#a ~ a[disabled]")[0][0] == "a"
    assert pick("p:first-child") == pick("p:nth-child(odd)") == [("p", "12")] and pick("p:lang(en)") == [("p", "3")]
    assert pick("[class~=y]")[0][0] == "div" and pick("[class=y]") == [] and pick("div :last-of-type")[-1] == ("p", "3")
    with pytest.raises(InvalidInput):
        H.selector("p >")
    assert H.parse("")[0].kind == "doc" and H.lines(None) == []


def test_html_deep_and_wide():
    import time

    deep = "<div>" * 100_000 + "x" + "</div>" * 100_000
    assert H.parse(deep)[-1].depth == 100_001 and H.lines(deep) == ["x"] and H.content(H.parse(deep)[1]) == "x"
    assert len(H.select(deep, "div div > div")) == 99_998 and H.select(deep, "p div") == []
    took = []
    for n in (20_000, 100_000):
        wide = "<p>a<br>" * n
        began = time.perf_counter()
        nodes = list(H.node_rows(wide))
        assert len(nodes) == 3 * n + 1 and nodes[-1][2] == 1 and nodes[-3][2] == n - 1
        assert len(H.select(wide, "p ~ p:nth-of-type(odd)")) == n // 2 - 1 + n % 2
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0]


def test_html_implied_ends():
    tree = lambda h: [(e.tag, e.depth) for e in H.parse(h) if e.kind == "tag"]
    assert tree("<p>a<p>b<div>c</div>") == [("p", 1), ("p", 1), ("div", 1)]
    assert tree("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == [("ul", 1), ("li", 2), ("ul", 3), ("li", 4), ("li", 4), ("li", 2)]
    assert tree("<table><tr><td>a<td><table><tr><td>b</table><tr><th>c</table>") == [("table", 1), ("tr", 2), ("td", 3), ("td", 3), ("table", 4), ("tr", 5), ("td", 6), ("tr", 2), ("th", 3)]
    assert tree("<dl><dt>a<dd>b<dt>c</dl>") == [("dl", 1), ("dt", 2), ("dd", 2), ("dt", 2)]
    assert tree("<select><option>a<option>b</select>") == [("select", 1), ("option", 2), ("option", 2)]
    assert tree("<p><b>a<p>b") == [("p", 1), ("b", 2), ("p", 1)]


def test_html_selectors_are_brute_force():
    """Every selector against its meaning, tried for each element."""
    import random

    r = random.Random(3)
    page = "".join(r.choice(["<div class=a>", "<div>", "</div>", "<p id=x>", "</p>", "<span class='a b'>", "</span>", "t", "<br>", "<!-- c -->"]) for _ in range(400))
    every = [e for e in H.parse(page) if e.kind == "tag"]
    up = lambda e: [] if e.parent is None or e.parent.kind == "doc" else [e.parent, *up(e.parent)]
    family = lambda e: [c for c in e.parent.children if c.kind == "tag"]
    earlier = lambda e: family(e)[: family(e).index(e)]
    cls = lambda e, c: c in e.attrs.get("class", "").split()
    rules = {
        "div span": lambda e: e.tag == "span" and any(x.tag == "div" for x in up(e)),
        "div > .a": lambda e: cls(e, "a") and up(e)[:1] != [] and e.parent.tag == "div",
        "p + span": lambda e: e.tag == "span" and earlier(e)[-1:] != [] and earlier(e)[-1].tag == "p",
        ".a ~ br": lambda e: e.tag == "br" and any(cls(x, "a") for x in earlier(e)),
        "div div .b": lambda e: cls(e, "b") and sum(x.tag == "div" for x in up(e)) > 1,
        "div p ~ span > br": lambda e: e.tag == "br" and e.parent.tag == "span" and any(x.tag == "p" and any(y.tag == "div" for y in up(x)) for x in earlier(e.parent)),
        ":nth-last-child(2)": lambda e: family(e)[::-1].index(e) == 1,
        "span:nth-of-type(2n+1)": lambda e: e.tag == "span" and [x for x in family(e) if x.tag == "span"].index(e) % 2 == 0,
    }
    for css, rule in rules.items():
        assert [e.id for e in H.select(page, css)] == [e.id for e in every if rule(e)], css


def test_html_in_sql(spark):
    H.register(spark)
    rows = spark.sql("SELECT t.line, t.text FROM VALUES ('<body><p>a</p>b') v(html), LATERAL html_text_lines(v.html) t").collect()
    assert sorted(map(tuple, rows)) == [(0, "a"), (1, "b")]
    assert spark.sql("SELECT text FROM html_select('<p>a</p><p class=x>b</p>', 'p.x')").first()["text"] == "b"
    assert spark.sql("SELECT count(*) FROM html_nodes('<p>a</p>')").first()[0] == 3


def test_parsec():
    value = P.Ref()
    value.parser = P.choice(P.regex(r"\d+", "number"), P.sequence("list", P.atom("["), P.kleene(value, "items", P.atom(",")), P.atom("]")))
    tree = P.parse_full(value, "[1,[2,3],[]]")
    assert tree.text() == "[1,[2,3],[]]"
    assert len(list(tree.rows())) == sum(1 for _ in tree.rows()) and "number '1'" in P.pretty(tree)
    with pytest.raises(P.ParseError):
        P.parse_full(value, "[1,")
    lex = P.Lex("é\nb+", 3)
    assert lex.position() == (2, 2) and P.literals("op", "++", "+")(lex).token == "+"
    with pytest.raises(P.ParseError):
        P.required("pair", P.atom("a"), P.atom("b"))(P.Lex("ac"))
    assert P.maybe(P.atom("x"))(P.Lex("y")).children == [] and P.many(P.atom("x"))(P.Lex("y")) is None
    assert P.ext(lambda s: 2, "two")(P.Lex("abc")).token == "ab"


def make_zim(path):
    """Two clusters, one compressed; four entries, one of them a redirect."""
    mimes = b"text/html\0image/png\0\0"
    entries = [
        struct.pack("<HBcIII", 0, 0, b"A", 0, 0, 0) + b"a\0Title A\0",
        struct.pack("<HBcIII", 0, 0, b"A", 0, 0, 1) + b"b\0\0",
        struct.pack("<HBcII", 0xFFFF, 0, b"A", 0, 0) + b"c\0\0",
        struct.pack("<HBcIII", 1, 0, b"I", 0, 1, 0) + b"d\0\0",
    ]

    def cluster(blobs, compress):
        head = 4 * (len(blobs) + 1)
        offsets, at = [], head
        for b in [*blobs, b""]:
            offsets.append(at)
            at += len(b)
        body = struct.pack(f"<{len(offsets)}I", *offsets) + b"".join(blobs)
        return bytes([4 if compress else 1]) + (lzma.compress(body) if compress else body)

    clusters = [cluster([b"<p>A</p>", b"<p>B</p>"], True), cluster([b"png"], False)]
    at = 80
    places = {}
    out = b""
    for name, data in (("mime", mimes), *((f"e{k}", e) for k, e in enumerate(entries)), *((f"c{k}", c) for k, c in enumerate(clusters))):
        places[name] = at + len(out)
        out += data
    url, title, cl = (at + len(out) + d for d in (0, 32, 48))
    out += struct.pack("<4Q", *(places[f"e{k}"] for k in range(4))) + struct.pack("<4I", 0, 1, 2, 3) + struct.pack("<2Q", places["c0"], places["c1"])
    header = struct.pack("<IHH16sIIQQQQIIQ", 0x44D495A, 6, 1, b"u" * 16, 4, 2, url, title, cl, places["mime"], 0, 0, at + len(out))
    path.write_bytes(header + out + hashlib.md5(header + out).digest())


def test_zim(spark, tmp_path):
    file = tmp_path / "t.zim"
    make_zim(file)
    e, b = zim.entries(spark, str(file)), zim.blobs(spark, str(file))
    assert [(r["url"], r["title"], r["redirect"]) for r in e.orderBy("id").collect()] == [("a", "Title A", None), ("b", "b", None), ("c", "c", 0), ("d", "d", None)]
    assert {r["url"]: bytes(r["content"]) for r in zim.contents(e, b).collect()} == {"a": b"<p>A</p>", "b": b"<p>B</p>", "c": b"<p>A</p>", "d": b"png"}
    assert {tuple(r) for r in zim.by_mime(e, zim.mimes(spark, str(file))).collect()} == {("text/html", 2), ("image/png", 1)}
    assert tuple(zim.info(e).first()) == (3, 1) and zim.header(spark, str(file)).first()["entry_count"] == 4
    assert [tuple(r["ids"]) for r in zim.by_cluster(e).orderBy("cluster").collect()] == [(0, 1), (3,)]
    assert zim.Archive(str(file)).titles() == [0, 1, 2, 3] and zim.namespace("A") == "article"
    (tmp_path / "bad").write_bytes(b"no")
    with pytest.raises(InvalidFile):
        zim.Archive(str(tmp_path / "bad"))
    loop = spark.createDataFrame([(0, 1), (1, 0), (2, None)], "id int, redirect int")
    assert {tuple(r) for r in zim.resolved(loop).collect()} == {(0, None), (1, None), (2, 2)}


def test_dump(spark, tmp_path):
    (tmp_path / "users.csv").write_text('gh_avatar,gh_id,gh_login,id,name\nx,1,ann,5,"A, ""B"""\ny,2,,6,Bo\n')
    (tmp_path / "versions.csv").write_text('crate_id,crate_size,created_at,downloads,features,id,license,num,published_by,updated_at,yanked\n1,,d,3,"{""std"":[""a""]}",9,MIT,1.0,,d,f\n')
    users = dump.table(spark, str(tmp_path), "users")
    assert {r["key"] for r in dump.documents(users, "users").collect()} == {"users/ann", "users/6"}
    v = dump.table(spark, str(tmp_path), "versions")
    assert dump.features(v).first()["features"] == {"std": ["a"]}
    assert '"num":"1.0"' in dump.document(v, "versions").first()["json"]


def test_folders(spark, tmp_path):
    repo = tmp_path / "x" / "r"
    repo.mkdir(parents=True)
    subprocess.run(["git", "init", "-q", str(repo)], check=True)
    (repo / "f").write_text("1")
    got = folders.repositories(spark, [str(tmp_path / "none"), str(tmp_path)]).collect()
    assert len(got) == 1 and got[0]["path"] == ["x", "r"] and got[0]["changes"] == 1
    (tmp_path / "c.toml").write_text("a = 1")
    assert folders.load_toml(folders.find_config(["c.toml"], [str(tmp_path)])) == {"a": 1}
    assert folders.files(spark, str(tmp_path), "*.toml").first()["path"] == ["c.toml"]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(X.humanize(F.lit(5_000_000))) == "4mb" and one(X.humanize(F.lit(12))) == "12b"
    assert one(X.parse_size(F.lit("10k"))) == 10240 and one(X.parse_size(F.lit("x"))) is None
    assert one(X.parse_sizes(F.lit("1k..8k"))) == [1024, 2048, 4096, 8192] and one(X.parse_sizes(F.lit("1,2k"))) == [1, 2048]
    assert one(X.blob_oid(F.lit(""))) == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    assert one(X.key_path(F.lit("ab"))) == ["a", "b", "ab"] and one(X.strict_path(F.lit("a/b"))) == ["a", "b"]
    with pytest.raises(Exception, match="not a plain path"):
        one(X.strict_path(F.lit("a/../b")))
