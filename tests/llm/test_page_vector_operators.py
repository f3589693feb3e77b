"""Operators 3, 6 and 10, the pipeline and the registration."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinsight.llm import exact_topk, host_reputation
from kinsight.llm.html_extract import extract_many, extract_pages, trained
from kinsight.llm.page_layouts import Layouts
from tests.llm.helpers import rows_of
from tests.llm.test_text_operators import contaminated, linked, secrets

Rule = host_reputation.Rule


def test_host_reputation(spark):
    rules = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow")]
    rows = [(1, "http://A.Example.NET/en/x?q"), (2, "http://example.net/fr#y"), (3, None), (4, "nothing here"), (5, "https://bad.test.org/a"), (6, "https://fine.test.org/a"), (7, "https://x.co.uk"), (8, "http://notexample.net"), (8, "http://notexample.net")]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in rows], "page_id long, url string, host string, verdict string")
    outcomes = spark.createDataFrame([("https://bad.test.org/", 1)] * 60 + [("https://fine.test.org/", 0)] * 60 + [(None, 1), ("https://fine.test.org/", None)], "url string, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in host_reputation.judge(pages, outcomes, rules).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2] == ("example.net", "/fr", "net/", "block")
    assert got[3] == ("", "", None, "allow") and got[4] == ("", "", None, "allow")
    assert got[5][3] == "block" and got[6][3] == "allow" and got[7][:2] == ("x.co.uk", "")
    assert got[8] == ("notexample.net", "", None, "allow")
    assert host_reputation.judge(pages, outcomes.limit(0), rules).count() == len(rows)
    assert host_reputation.judge(pages.limit(0), outcomes, rules).collect() == []


def test_hosts_that_are_credibly_worse(spark):
    """Of hosts with one bad rate but for three, exactly those three are blocked, whatever their domain and how rows repeat."""
    bad = {"h3.a.com": 32, "h11.b.org": 30, "casino.c.co.uk": 36}
    hosts = [f"h{k}.{'abc'[k % 3]}.{'com' if k % 2 else 'org'}" for k in range(40)] + list(bad)
    told = [(f"http://{h}/p{i}", int(i < bad.get(h, 4 + k % 3))) for k, h in enumerate(hosts) for i in range(40)]
    long = "https://h1.a.com/" + "x" * 100_000
    pages = spark.createDataFrame([(i, f"https://{h.upper()}/x?y") for i, h in enumerate(hosts)] * 2 + [(-1, long), (-2, "https://new.a.com/")], "page_id long, url string")
    got = host_reputation.judge(pages, spark.createDataFrame(told, "url string, bad int"), []).collect()
    assert len(got) == len(hosts) * 2 + 2
    assert {r.host for r in got if r.verdict == "block"} == set(bad)
    assert [r.verdict for r in got if r.page_id < 0] == ["allow", "allow"] and max(len(r.path) for r in got) == 100_001


def test_hosts_that_differ_by_chance_alone(spark):
    r = np.random.default_rng(3)
    told = [(f"http://h{k}.d{k % 7}.com/", int(r.random() < 0.25)) for k in range(60) for _ in range(30)]
    pages = spark.createDataFrame([(k, f"http://h{k}.d{k % 7}.com/") for k in range(60)], "page_id long, url string")
    assert {x.verdict for x in host_reputation.judge(pages, spark.createDataFrame(told, "url string, bad int"), []).collect()} == {"allow"}


def test_exact_topk(spark):
    import random

    r = random.Random(8)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(90)] + [(i, [0.5] * 8) for i in range(100, 160)]
    odd = [(200, None), (201, [1.0, None]), (202, [float("nan")]), (203, [float("inf")]), (204, []), (220, [0.5] * 8), (220, [0.5] * 8)]
    frame = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows + odd], "vec_id long, embedding array<double>, score double, rank int")
    usable = {i: [math.floor(64 * x) for x in v] for i, v in rows + odd if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in usable if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)[:7]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    got = exact_topk.top_k(frame, k=7, query_block=3, candidate_block=40)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    few = exact_topk.top_k(frame.where("vec_id IN (0, 1, 2)"), k=7)
    assert few.count() == 2
    assert exact_topk.top_k(frame.limit(0)).collect() == []


def test_refinement_in_steps(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "BINS", 4)
    frame = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "vec_id long, embedding array<double>")
    got = rows_of(exact_topk.top_k(frame, k=2), "query_id", "rank", "vec_id")
    assert (20, 1, 39) in got and (0, 1, 1) in got


@pytest.fixture(scope="module")
def model():
    return trained()


def test_extraction(spark, model):
    article = "<article><h1>Title here</h1><p><b>One two &amp; three.<br><p>Four&nbsp;five\n six. Seven eight nine ten.</p></article>"
    page = f"<html><head><title>T</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy now, it is good.</div>{article}<div class='comments'><p>Nice post. I liked it.</p></div><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<div>" * 5000 + "x"), (1, "u", page)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = extract_pages(frame, model=model).collect()
    text = {r.page_id: r.text for r in got}
    assert text[1] == "Title here\nOne two & three.\nFour five six. Seven eight nine ten."
    assert text[2] == "" and text[3] == "" and len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(frame.limit(0), model=model).collect() == []


def test_held_out_layouts(model):
    import re

    layouts, right = Layouts(4321), 0
    for _ in range(60):
        page = layouts.page()
        want = " ".join(re.sub(r"<[^>]+>", " ", b).split() and " ".join(re.sub(r"<[^>]+>", " ", b).split()) for b in re.findall(r'<(?:p|h1|h2|ul|blockquote|table|div) data-k="1">(.*?)(?=<[^>]*data-k|</article|</main|</section|</div>)', page, re.S))
        right += set(want.split()[:40]) <= set(extract_many([page], model)[0].split())
    assert right >= 45


def test_registration():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def masked(text):
    """Brute force: the stretches that secrets cover, replaced by the marker."""
    spans = sorted(tuple(map(int, s.split(":")[1:])) for s in secrets(text))
    out, at = [], 0
    for start, end in spans:
        if out and start <= at:
            at = max(at, end)
        else:
            out += [text[at:start], "[SECRET]"]
            at = end
    return "".join(out) + text[at:]


def test_pipeline_by_brute_force(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    good = corpus_pipeline.quality(spark, frame, sf_dir)
    assert good.columns == frame.columns and 0 < good.count() < frame.count()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    stays = {d for d, n, c in linked(rows) if d == c}
    rows = [(d, t) for d, t in rows if d in stays]
    clean = {r[0] for r in contaminated(rows, items) if not r[-1]}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in rows:
        if d in clean:
            ids = np.array(library.encode(masked(t), add_special_tokens=False).ids, "<u4").tobytes()
            want.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(masked(t).encode()).hexdigest()))
    assert rows_of(corpus_pipeline.run(spark, sf_dir), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
