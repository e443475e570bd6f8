"""Packing, WARC, HTML and the pipeline."""

import base64
import gzip
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_minhash import brute

import corpus_pipeline
from quern.llm import html_text as H
from quern.llm import packing as P
from quern.llm import warc as W
from quern.llm.common import table

SF01 = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x2FF, exclude_categories=["Cs"]), st.sampled_from(" '\n\tsdtrevml")), max_size=40))
def test_cached_ids_are_the_tokenizers(text):
    e = P.encoder(TOKENIZER)
    for t in (text, text + "<|endoftext|>", text + " 日本"):
        assert e.encode(t) == np.array(e.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_a_full_cache_changes_nothing():
    e = P.Encoder(TOKENIZER)
    e.most = 5
    text = " ".join(f"word{k % 9} x{k}" for k in range(200))
    assert e.encode(text) == P.encoder(TOKENIZER).encode(text)


def best_fit_decreasing(counts):
    gaps = []
    for s in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fit = [g for g in gaps if g >= s]
        g = min(fit) if fit else 1024
        if fit:
            gaps.remove(g)
        gaps.append(g - s)
    return len(gaps)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 1024), st.integers(1, 40), max_size=60))
def test_plan_places_all_items(counts):
    groups, got = P.plan(counts), {}
    for g in groups:
        assert g.gap >= 0 and sum(s * n for s, n in g.items) + g.gap == 1024
        assert sum(n for s, n in g.items if 3 * s > 1024) <= 2
        for s, n in g.items:
            got[s] = got.get(s, 0) + n * g.bins
    assert got == counts
    assert sum(g.bins for g in groups) <= 1.05 * best_fit_decreasing(counts) + 1


def test_packing_round_trip(spark):
    rng = random.Random(0)
    docs = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.choice((0, 3, 300, 700, 1023, 1024, 2500))))) for i in range(40)]
    docs += [(50, None), (51, ""), (None, "no id"), (3, "repeated id"), (60, "z" * 20000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("length", F.lit(1))
    rows = P.pack(P.pieces_of(df, TOKENIZER)).collect()
    e = P.encoder(TOKENIZER)
    assert sum(r["length"] for r in rows) == sum(len(e.encode(t)) // 4 + 1 for _, t in docs)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["length"] == 1024 or r["piece"] == 0
    for parts in by.values():
        end = 0
        for a, n in sorted(parts):
            assert a == end
            end += n
        assert end <= 1024
    assert P.pack(P.pieces_of(df.limit(0), TOKENIZER)).count() == 0


PAGES = [(1, "http://a/é b", "<p>x"), (2, None, "<p>x"), (3, "u\r\nX: y", None), (4, "u", ""), (5, "u", "é" * 70000), (0, "u", "y\r\n\r\nWARC/1.1"), (7, "u", "y\r\n\r\nWARC/1.1"), (7, "u", "y\r\n\r\nWARC/1.1"), (None, "u", "<p>x")]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("sha", F.lit(1))
    own = W.archive(df.coalesce(1)).collect()
    for r in own:
        (tmp_path / r["name"]).write_bytes(r["content"])
        assert gzip.decompress(r["content"]).startswith(b"WARC/1.1\r\n")
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[sha(h)] = min(first.get(sha(h), i), i)
    want = sorted((str(i), len((h or "").encode()), sha(h), "revisit" if i is not None and first[sha(h)] != i else "response", str(first[sha(h)]) if i is not None and first[sha(h)] != i else "None") for i, _, h in PAGES)
    for got in (W.read(W.archive(df)), W.read_files(spark, str(tmp_path))):
        assert sorted((str(r[0]), r[1], r[2], r[3], str(r[4])) for r in got.collect()) == want
    assert W.read(W.archive(df.limit(0))).count() == 0
    assert {r["record_type"] for r in W.read(W.archive(df, least_bytes=10**6)).collect()} == {"response"}


def test_broken_archives_raise():
    good = W.info_record() + W.page_record("1", "u", "hello", None)
    assert len(list(W.read_records(bytes([b]) for b in good))) == 2
    with pytest.raises(ValueError, match="ends within"):
        list(W.read_records([good[:-9]]))
    changed = gzip.compress(gzip.decompress(W.page_record("1", "u", "hello", None)).replace(b"hello", b"hallo"))
    with pytest.raises(ValueError, match="digest"):
        list(W.read_records([changed]))


def test_records_of_other_writers(spark, tmp_path):
    record_id = "<urn:uuid:12345678-1234-1234-1234-123456789abc>"
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 999\r\n\r\nbody"
    data = W.encode_record([("WARC-Type", "request"), ("WARC-Record-ID", record_id)], b"GET / HTTP/1.1\r\n\r\n")
    data += W.encode_record([("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Payload-Digest", "sha256:00")], http)
    data += W.encode_record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id)], b"")
    (tmp_path / "a b.warc.gz").write_bytes(data)
    sha = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    want = [(None, 4, sha, "response", None), (None, None, None, "revisit", None)]
    for got in (W.read_files(spark, str(tmp_path)), W.read(spark.createDataFrame([(bytearray(data),), (None,), (bytearray(),)], "content binary"))):
        assert sorted(map(tuple, got.collect()), key=str) == want
    with pytest.raises(Exception, match="ends within"):
        W.read(spark.createDataFrame([(bytearray(data[:-9]),)], "content binary")).collect()


def test_unresolved_references(spark):
    rows = [(1, 5, "A", "response", None), (2, 5, "A", "revisit", 1), (3, 5, "A", "revisit", 1), (4, 6, "A", "revisit", 1), (5, 5, "A", "revisit", 9)]
    got = W.unresolved(spark.createDataFrame(rows, W.SCHEMA)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "A", 6), (9, "A", 5)]


def test_records_against_sql(spark, duck):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = sorted(duck.execute(f"select {', '.join(names)} from ({W.ORACLE_SQL})").fetchall(), key=str)
    assert sorted((tuple(r[n] for n in names) for r in W.op9(spark, SF).collect()), key=str) == want


def test_html_layout():
    page = """<!doctype html><title>t</title><body><h1>Head &amp; more</h1><p>one<p>two <b>b</b><br>line<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>
<table><tr><th>name<th>v<tr><td>long name<td>1<tr><td colspan=2>both</table><script>no</script><div style="display:none">no</div><p hidden>no<pre> a
  b</pre><!-- no --><dl><dt>t<dd>d</dl>"""
    assert H.visible_text(page).split("\n") == [
        "Head & more", "", "one", "", "two b", "line", "", "- a", "- b", "  3. x", "  4. y", "", "name      | v", "long name | 1", "both", "", " a", "  b", "", "t", "  d",
    ]


def test_all_visible_text_and_no_other():
    page = """<head><title>t0</title></head><p>v1<span style="visibility: hidden">h1<b style="visibility:visible">v2</b>h2</span>
<div style="display:none">h3<b style="visibility:visible">h4</b></div><div style="display:none; display:block">v3</div>
<details><summary>v4</summary>h5<p>h6</p></details><details open><summary>v5</summary>v6</details><details>h7</details>
<textarea>v7
  v8</textarea><select><optgroup label="v9"><option>v10<option selected>v11</select><datalist><option>h8</datalist>
<math><mi>v12</mi><mo>+</mo><annotation>h9</annotation></math><svg><title>h10</title><g>h11<text>v13<tspan>v14</tspan></text></g><defs><text>h12</text></defs><foreignObject><p>v15</p></foreignObject></svg>
<dialog>h13</dialog><dialog open>v16</dialog><map><a>v17</a></map><noscript>h14</noscript><template>h15</template><ul><li style="visibility:hidden">h16<li>v18</ul><table><tr style="visibility:collapse"><td>h17<td style="visibility:visible">v19</table>"""
    text = H.visible_text(page)
    assert re.findall(r"[hvt]\d+", text) == [f"v{k}" for k in range(1, 20)]
    lines = text.split("\n")
    assert "v7" in lines and "  v8" in lines and "v10" in lines and "- v18" in lines and "v12+" in text


INLINE = ("b", "i", "span", "a", "em")


def written(rng, depth, words, seen):
    """Random well-formed markup; words gets the visible ones, by a rule of its own: what is written here as shown."""
    out = ""
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.4 or not depth:
            word = f"w{rng.randint(0, 10**6)}"
            out += f" {word} "
            words += [word] if seen else []
        elif kind < 0.6:
            out += f"<{(t := rng.choice(INLINE))}>{written(rng, depth - 1, words, seen)}</{t}>"
        elif kind < 0.8:
            out += f"<div>{written(rng, depth - 1, words, seen)}</div>"
        elif kind < 0.88:
            out += f'<span style="visibility:hidden">{written(rng, depth - 1, words, False)}</span>'
        elif kind < 0.94:
            out += f"<{(t := rng.choice(('template', 'div hidden', 'dialog', 'details')))}>{written(rng, depth - 1, [], False)}</{t.split()[0]}>"
        else:
            out += f'<em style="visibility:visible">{written(rng, depth - 1, words, True)}</em>'
    return out


def test_visible_words_against_how_pages_were_written():
    rng = random.Random(3)
    for _ in range(300):
        words = []
        page = written(rng, 5, words, True)
        # hidden subtrees may hold visible spans again only where visibility, not display, hides them
        assert H.visible_text(page).split() == words, page


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("<p> </p> <table> </table> <td> <tr> <li> <ul> </ul> <pre> </pre> text <b </x> <br/> <td colspan=9 <dd> &amp; <![ <select> <option>".split(" ")), max_size=30))
def test_broken_html_never_raises(parts):
    text = H.visible_text("<div>".join(parts))
    assert "\n\n\n" not in text or parts.count("<br/>") > 1 or "<pre>" in parts


def test_html_of_odd_pages(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "<div>" * 3000 + "deep"), (4, "x" * 200000)], "page_id long, html string").withColumn("text", F.lit(1))
    got = {r["page_id"]: r["n_chars"] for r in H.extract(df).collect()}
    assert got == {1: 0, 2: 0, None: 4, 4: 200000} and H.extract(df.limit(0)).count() == 0


def test_pipeline_stages_against_their_operators(spark):
    docs, columns = table(spark, SF01, "documents"), table(spark, SF01, "documents").columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF01).persist()
        kept.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert kept[0] > kept[1] > kept[2] > kept[3] == kept[4] > 0
    assert docs.select("doc_id").distinct().count() == kept[4]


def test_pipeline_of_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, row long"
    rows = [(1, None, None, None, None, "s", 1), (2, "", "en", "a", 0, "s", 2), (None, "no id", "en", "a", 5, "s", 3), (4, 'token = "abcdefghijklmnop" here', "en", "a", 31, "s", 4)]
    for given_rows in (rows, []):
        docs = spark.createDataFrame(given_rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name == "secrets":
                got = {r["doc_id"]: (r["text"], r["n_chars"], r["spans"]) for r in docs.collect()}
        if given_rows:
            assert got == {1: (None, None, "s"), 2: ("", 0, "s"), None: ("no id", 5, "s"), 4: ("[SECRET]\" here", 14, "s")}
        assert docs.count() == len(given_rows)


def test_near_dedup_stage_against_brute_force(spark):
    rng = np.random.default_rng(7)
    made = []
    for n in (49, 54, 60, 110, 120):  # two changed words or one, for similarities around 0.80 and 0.85
        words = [f"w{k}" for k in rng.integers(0, 10**6, n)]
        made += [words, [*words[:20], "other", *words[21:]], [*words[:20], "other", *words[21:35], "more", *words[36:]]]
    own = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string")
    for docs in (own, table(spark, SF01, "documents").select("doc_id", "text")):
        rows = [tuple(r) for r in docs.collect()]
        kept = lambda percent: {i for i, (_, c) in brute(rows, percent).items() if i == c}  # noqa: B023, E731
        got = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF01).collect()}
        assert got == kept(80) < kept(85)
