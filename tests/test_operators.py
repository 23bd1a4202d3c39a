"""Kernels and operators against plain restatements, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from graticule.functions import html, text, web
from graticule.operators import catalog, chunking, context, retrieval, selection
from graticule.operators.index import CorpusIndex, l2_normalize
from graticule.sources import guides
from graticule.streaming import jobs


def one(spark, column, value="", kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value, want",
    [(None, []), ("", []), ("?!", []), ("Ab1-cd", ["ab1", "cd"]), ("café", ["caf"]), ("ſıK", ["ſık"]), ("A b A", ["a", "b", "a"])],
)
def test_tokens(spark, value, want):
    assert one(spark, text.tokens(F.col("x")), value) == want


@pytest.mark.parametrize("value, want", [("a\r\nb\x0bc\n", ["a", "b", "c"]), ("", []), ("x\n\n", ["x", ""])])
def test_lines_are_those_of_python(spark, value, want):
    assert one(spark, text.lines(F.col("x")), value) == want == value.splitlines()


@pytest.mark.parametrize("value", ["", "---\na: 1\n---\nbody", "---\nno end", "﻿---\nk: 'v'\n---\n\n\nbody\n", "---x\n---\n", "---\n---\nx"])
def test_front_matter(spark, value):
    got = one(spark, text.front_matter(F.col("x")), value)
    bare = value.lstrip("﻿")
    lines = bare.splitlines()
    end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None) if lines and lines[0].strip() == "---" else None
    if end is None:
        assert (got["front"], got["body"]) == (None, value)
    else:
        assert got["front"] == "\n".join(lines[1:end])
        assert got["body"].rstrip("\n") == "\n".join(lines[end + 1 :]).lstrip("\n")


def test_front_matter_fields(spark):
    got = one(spark, text.front_matter_fields(F.col("x")), "title: \"A b\"\ncover:\n  logo: 'x.png'\n  stray\nlast: 1")
    assert got == {"title": "A b", "cover.logo": "x.png", "last": "1"}


@pytest.mark.parametrize(
    "value, want",
    [
        ("(https://a.b/c).", "https://a.b/c"), ("www.x.y", "https://www.x.y"), ("example.com/path?q", "https://example.com/path?q"),
        ("file.txt", None), ("no", None), ("", None), ("<sub.example.org:80>", "https://sub.example.org:80"), ("a b.com", None),
    ],
)
def test_normalize_url(spark, value, want):
    assert one(spark, web.normalize_url(F.col("x")), value) == want


def test_extract_urls_keeps_the_first_of_equal_ones(spark):
    assert one(spark, web.extract_urls(F.col("x"), 5), "see www.a.com and https://b.c/d, www.a.com") == ["https://b.c/d", "https://www.a.com"]


def test_bounded_body():
    assert web.bounded_body(b"abcdef", "text/html; charset=utf-8", 4, 3) == {"text": "abc", "truncated": True}
    with pytest.raises(ValueError):
        web.bounded_body(b"x", "image/png")


def test_template_needs_its_placeholders():
    with pytest.raises(ValueError):
        text.render_template("no placeholder", {}, ("context",))


def test_tables_are_flattened(spark):
    assert one(spark, text.flatten_tables(F.col("x")), "a\n| b | **c**  d |\n|---|:-:|\n||\nx|y\n") == "a\nb - c d\nx - y"


@pytest.mark.parametrize("seed", range(5))
def test_chunks_keep_within_the_bound_and_lose_nothing(seed):
    r = random.Random(seed)
    body = "".join(r.choice("abc  \n\n") for _ in range(3000))
    for most in (10, 50, 400):
        chunks = chunking.chunk_markdown(body, most)
        assert all(0 < len(c) <= most for c in chunks)
        assert "".join("".join(chunks).split()) == "".join(body.split())


def test_long_block_prefers_a_line_break():
    assert chunking.split_long_block("aaaa bbbb\ncccc dddd", 12) == ["aaaa bbbb", "cccc dddd"]
    assert chunking.split_long_block("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert chunking.split_long_block("  ", 10) == []


def test_sections_and_levels():
    page = "lost\n## A\na\n### B\nb\n```\n# code\n```\n## C\nc".splitlines()
    found = chunking.headings(page, "T")
    assert [(level, path) for _, level, path in found] == [(2, ["T", "A"]), (3, ["T", "A", "B"]), (1, ["T", "code"]), (2, ["T", "code", "C"])]
    assert chunking.semantic_levels({1, 2, 3}) == (2, 3)
    assert chunking.semantic_levels({1}) == (1, None)
    assert chunking.semantic_levels(set()) == (None, None)
    assert [t.split("\n")[0] for _, t in chunking.sections(page, found, 2)] == ["## A", "## C"]


def test_images_close_blocks():
    assert chunking.split_on_images("a\n![x](u1)\nb", ["T"]) == [("a", ["u1"]), ("b", [])]
    assert chunking.split_on_images("![x](u1)![y](u2)\nb", ["T", "H"]) == [("T > H", ["u1", "u2"]), ("b", [])]
    assert chunking.split_on_images("a ![x](u1)\n![y](u2)", []) == [("a", ["u1", "u2"])]
    assert chunking.split_on_images("\n![x](u1)\nb", ["T"]) == [("b", [])]


def test_html_to_markdown():
    page = '<html><body><div id="mainbody"><script>no</script><h2>A &amp; B</h2><p>x <b>y</b></p><ul><li>one</li><li>two</li></ul><table class="hs-box"><tr><td class="hs-box-icon"><img src="warning.png"></td><td class="hs-box-content">Mind   this</td></tr></table><img src="./p.png" alt="P"><img src="data:xx" alt="D"></div></body></html>'
    out = html.html_to_markdown(page, "T")
    assert out.startswith("# T\n\n## A & B\n\nx **y**")
    assert "* one\n* two" in out and "**Warning:** Mind   this" in out
    assert "![P](p.png)" in out and "[Image: D]" in out and "no" not in out.split("T", 1)[1].replace("note", "")
    assert html.html_to_markdown("", "T") == "# T\n"


def test_contents_levels_are_clamped():
    row = '<table class="TableOfContents"><tr>{}<td><a class="__tocentry" href="{}#x">{}</a></td></tr></table>'
    blank = '<td width="10"></td>'
    page = row.format("", "a.html", "A") + row.format(blank * 3, "b.html", "B") + row.format(blank, "c.html", "C") + row.format("", "d.html", "D")
    assert html.toc_paths(page, "G") == {"a.html": ["G", "A"], "b.html": ["G", "A", "B"], "c.html": ["G", "A", "C"], "d.html": ["G", "D"]}


def test_admonitions():
    assert html.admonitions("> [!TIP] Hi\n> a\n>b\nc") == "::: tip Hi\na\nb\n:::\nc"
    assert html.admonitions("```\n> [!TIP]\n```") == "```\n> [!TIP]\n```"


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, doc_id string, page_id string, text string")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def test_bm25_edges(spark):
    rows = chunks(spark, [(1, "d", "p", "alpha beta"), (2, "d", "p", "alpha beta"), (3, "d", "q", "?!"), (4, "e", "r", "gamma"), (5, "e", "r", None)])
    got = retrieval.bm25(queries(spark, "alpha alpha", "", "unseen", "the"), rows, 8).orderBy("qid", "rank").collect()
    assert [(r["qid"], r["chunk_id"]) for r in got] == [(0, 1), (0, 2)]  # repeated terms count once; ties go by id
    only = retrieval.bm25(queries(spark, "alpha"), rows, 8, spark.createDataFrame([(2,)], "chunk_id long")).collect()
    assert [(r["chunk_id"], round(r["score"], 9)) for r in only] == [(2, round(got[1]["score"], 9))]


def test_scores_do_not_depend_on_partitioning(spark, sf_dir):
    from graticule.plans.registry import QUERIES, load_all

    load_all()
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        out = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(sorted(map(tuple, QUERIES["bm25_topk"](spark, sf_dir).collect())))
        assert out[0] == out[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_vector_dimensions_must_agree(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "chunk_id long, vector array<float>")
    with pytest.raises(ValueError):
        retrieval.vector_rank(v.withColumnRenamed("chunk_id", "qid"), v, 1)


def test_zero_vector_stays(spark):
    assert one(spark, l2_normalize(F.col("x")), [0.0, 0.0], "array<double>") == [0.0, 0.0]
    assert one(spark, l2_normalize(F.col("x")), [3.0, 4.0], "array<double>") == pytest.approx([0.6, 0.8])


def test_rrf_is_symmetric_and_fills_gaps(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 2)], "qid long, chunk_id long, rank int")
    b = spark.createDataFrame([(0, 2, 1), (0, 3, 2)], "qid long, chunk_id long, rank int")
    one_way = {r["chunk_id"]: r["score"] for r in retrieval.rrf(a, b).collect()}
    assert one_way == {r["chunk_id"]: r["score"] for r in retrieval.rrf(b, a).collect()}
    assert one_way[1] == pytest.approx(1 / 61) and one_way[2] == pytest.approx(1 / 61 + 1 / 62)


def test_factors(spark):
    f = lambda c: one(spark, c, "x")
    assert f(retrieval.heading_factor(F.lit("the of"), F.lit("the"), 0.5)) == 1.0
    assert f(retrieval.heading_factor(F.lit("the red cat"), F.lit("Red > dog"), 0.5)) == 1.25
    assert f(retrieval.priority_factor(F.lit("b"), ["a", "b", "c"], 0.2)) == pytest.approx(1.1)
    assert f(retrieval.priority_factor(F.lit("z"), ["a", "b"], 0.2)) == 1.0
    assert f(retrieval.priority_factor(F.lit("a"), ["a"], 0.2)) == 1.0


def greedy(rows, k, page_cap, doc_cap):
    pages, docs, out = {}, {}, []
    for score, cid, doc, page in sorted(rows, key=lambda r: (-r[0], r[1])):
        if page_cap > 0 and pages.get((doc, page), 0) >= page_cap or doc_cap > 0 and docs.get(doc, 0) >= doc_cap:
            continue
        pages[doc, page] = pages.get((doc, page), 0) + 1
        docs[doc] = docs.get(doc, 0) + 1
        out.append(cid)
        if len(out) == k:
            break
    return out


@pytest.mark.parametrize("caps", [(0, 0), (1, 2), (2, 3), (9, 9)])
def test_two_windows_equal_greedy_caps(spark, caps):
    r = random.Random(sum(caps))
    rows = [(r.randint(1, 5) / 2, i, r.choice("ab"), r.choice("pq")) for i in range(40)]
    frame = spark.createDataFrame([(0, s, c, d, p) for s, c, d, p in rows], "qid long, score double, chunk_id long, doc_id string, page_id string")
    got = [x["chunk_id"] for x in selection.capped_top_k(frame, 10, *caps).orderBy("rank").collect()]
    assert got == greedy(rows, 10, *caps)


def test_mmr_with_full_weight_is_the_capped_top_k():
    r = random.Random(3)
    rows = [(r.random(), i, r.choice("ab"), r.choice("pq")) for i in range(30)]
    best = sorted(rows, key=lambda x: (-x[0], x[1]))
    picked = selection.mmr_choose([x[0] for x in best], [(None, {str(x[1])}) for x in best], [x[2:] for x in best], [x[2] for x in best], 8, 1.5, 2, 5)
    assert [best[i][1] for i, _ in picked] == greedy(rows, 8, 2, 5)


def test_mmr_prefers_what_differs():
    words = [{"a", "b"}, {"a", "b"}, {"c"}]
    picked = selection.mmr_choose([1.0, 0.9, 0.5], [(None, w) for w in words], [0, 1, 2], [0, 1, 2], 2, 0.5, 0, 0)
    assert [i for i, _ in picked] == [0, 2]
    assert selection.mmr_choose([], [], [], [], 3, 0.5, 0, 0) == []
    assert [i for i, _ in selection.mmr_choose([1.0, 1.0], [([1.0], set()), ([-1.0], set())], [0, 1], [0, 1], 1, 0.8, 0, 0)] == [0]


def test_expansion_skips_what_does_not_fit_and_walks_on():
    near = {1: "L1", 0: "L0", 3: "R" * 50, 4: "R4"}
    assert context.walk(2, "centre", near, 2, 20)[0] == "L0\n\nL1\n\ncentre\n\nR4"
    assert context.walk(2, "centre" * 9, near, 2, 20)[0] == ("centre" * 9)[:20]
    assert context.walk(2, "c", near, 1, 0)[0] == "L1\n\nc\n\n" + "R" * 50


@pytest.mark.parametrize(
    "answer, want",
    [
        ('REQUEST_MORE_CONTEXT\n{"query": "q", "k": 40, "doc_ids": "d"}', ("q", 25, ["d"])),
        ('REQUEST_MORE_CONTEXT\n```json\n{"query": "q", "k": "x"}\n```', ("q", 8, None)),
        ('REQUEST_MORE_CONTEXT\n{"k": 3}', None),
        ('Well REQUEST_MORE_CONTEXT\n{"query": "q"}', None),
        ("", None),
        (None, None),
    ],
)
def test_context_request(spark, answer, want):
    got = one(spark, context.context_request(F.col("x")), answer)
    assert (got and (got["query"], got["k"], got["doc_ids"])) == want


def test_upsert_keeps_creation_and_request_resets_review(spark):
    ddl = "doc_id long, status string, content string, created_at string, updated_at string, reviewed_by long, reviewed_at string, review_note string"
    old = spark.createDataFrame([(1, "approved", "a", "2020", "2020", 5, "2020", "ok"), (2, "pending", "b", "2020", "2020", None, None, None)], ddl)
    new = spark.createDataFrame([(1, None, "c", "2021", "2021", None, None, None)], ddl)
    got = {r["doc_id"]: r for r in catalog.request_publish(old, new, ["doc_id"]).collect()}
    assert (got[1]["status"], got[1]["content"], got[1]["created_at"], got[1]["reviewed_by"]) == ("pending", "c", "2020", None)
    assert got[2]["content"] == "b"


def test_phases(spark):
    said = ["Ingesting doc: x", "  Done: y", "Indexing 3", "noise", "ERROR: z"]
    log = spark.createDataFrame([(0, i, s) for i, s in enumerate(said)], "job long, n long, line string")
    got = jobs.job_progress(log, "job", "n", "line").orderBy("n").collect()
    assert [(r["phase"], r["doc_done"]) for r in got] == [("converting_html_to_md", 0), ("converting_html_to_md", 1), ("indexing_bm25", 1), ("indexing_bm25", 1), ("failed", 1)]


def test_index_round_trip_and_swap(spark, tmp_path):
    index = CorpusIndex.build(chunks(spark, [(1, "d", "p", "alpha beta beta"), (2, "d", "p", "alpha")]))
    for n in range(3):
        build, live = str(tmp_path / "build"), str(tmp_path / "live")
        index.save(build)
        guides.swap(spark, build, live, keep=1)
    loaded = CorpusIndex.load(spark, live)
    assert loaded.ready() and not loaded.embeddings_ready()
    assert sorted(map(tuple, loaded.terms.collect())) == [("alpha", 2), ("beta", 1)]
    assert len([p for p in tmp_path.iterdir() if ".bak_" in p.name]) == 1


def test_guides_are_read_in_contents_order(spark, tmp_path):
    guide = tmp_path / "My Guide"
    guide.mkdir()
    (guide / "b.html").write_bytes(b"\xef\xbb\xbf<body><p>B \xff</p></body>")
    (guide / "a.html").write_text("<body><p>A</p></body>")
    (guide / "__tableofcontents.html").write_text('<table class="TableOfContents"><td><a class="__tocentry" href="b.html">Bee</a></td></table>')
    got = guides.read_guides(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["page_id"], r["heading_path"], r["markdown"]) for r in got] == [("my-guide", "b", ["My Guide", "Bee"], "# b\n\nB\n")]


def test_catalogue_reader(spark, tmp_path):
    path = tmp_path / "pages.jsonl"
    path.write_text('{"doc_id": "d", "page_id": "p", "images": []}\nbroken\n')
    assert [r["page_id"] for r in guides.read_catalog(spark, str(path), strict=False).collect()] == ["p"]
    with pytest.raises(Exception, match="line 2"):
        guides.read_catalog(spark, str(path)).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = chunks(spark, [(1, "d", "p", "alpha beta"), (2, "d", "p", "alpha")])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    jobs.ingest_stream(stream, str(tmp_path / "index"), str(tmp_path / "state")).awaitTermination()
    _, terms = jobs.read_ingested(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, terms.collect())) == [("alpha", 2), ("beta", 1)]


def test_empty_tables(spark):
    rows = chunks(spark, [])
    assert retrieval.bm25(queries(spark, "a"), rows, 3).count() == 0
    assert retrieval.bm25(queries(spark), chunks(spark, [(1, "d", "p", "a")]), 3).count() == 0


def test_indented_headings_count(spark):
    page = ["  ## In", "\t### Deep ", "## Flat", "#no", "####### seven"]
    assert chunking.headings(page, "T") == [(0, 2, ["T", "In"]), (1, 3, ["T", "In", "Deep"]), (2, 2, ["T", "Flat"])]
    frame = spark.createDataFrame([(1, "T", "\n".join(page))], "k long, title string, body string")
    assert [(r["line"], r["level"], r["path"]) for r in chunking.heading_paths(frame, "k", "title", "body").orderBy("line").collect()] == chunking.headings(page, "T")


@pytest.mark.parametrize("seed", range(4))
def test_long_blocks_are_cut_as_stated(seed):
    r = random.Random(seed)
    for most in (5, 10, 37):
        body = "".join(r.choice("abc  \n") for _ in range(400))
        rest, want, low = body.strip(), [], int(most * 0.6)
        while len(rest) > most:
            window = rest[low:most]
            at = low + window.rfind("\n") if "\n" in window else low + window.rfind(" ") if " " in window else most
            want.append(rest[:at].rstrip())
            rest = rest[at:].lstrip()
        assert chunking.split_long_block(body, most) == [x for x in [*want, rest] if x]


def test_embedding_falls_back_to_shorter_texts(spark):
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if any(len(t) > 300 for t in texts):
            raise RuntimeError("too long")
        return [{"index": i, "embedding": [float(len(t)), float(i)]} for i, t in reversed(list(enumerate(texts)))]

    texts = ["a " * 200, "short"]
    got = chunking.embed_batch(embed, texts, [[], []], 2)
    assert got == [[256.0, 0.0], [5.0, 1.0]] and len(calls) == 3 * 11 + 1  # the batch, ten cuts that are too long, and 256

    def picky(texts):
        if len(texts) > 1 or "é" in texts[0] or not texts[0]:
            raise RuntimeError("no")
        return [[1.0, 2.0]]

    assert chunking.embed_batch(picky, ["xé", "y"], [["xé", "x"], []], 2) == [[1.0, 2.0]] * 2
    with pytest.raises(RuntimeError):
        chunking.embed_batch(picky, ["é"], [["é"]], 2)
    with pytest.raises(RuntimeError):
        chunking.embed_batch(lambda t: [[1.0]] * len(t), ["a"], [[]], 2)
    rows = spark.createDataFrame([(1, "ﬁne…"), (2, None)], "chunk_id long, text string")
    out = {r["chunk_id"]: r["vector"] for r in chunking.with_embeddings(rows, lambda texts: [[float(len(t))] for t in texts], 1).collect()}
    assert out == {1: [7.0], 2: [0.0]}  # the ligature is two letters, the ellipsis three dots


@pytest.mark.parametrize("seed", range(3))
def test_bags_agree(spark, seed):
    r = random.Random(seed)
    body = " ".join(r.choice(["Ab", "ab", "x", "long" * 9, "9", f"w{r.randint(0, 200)}"]) for _ in range(400))
    words, seen, bag = body.split(), set(), ""
    for w in words:
        if w.lower() not in seen and len(bag) < 420:
            seen.add(w.lower())
            bag = f"{bag} {w}" if bag else w
    assert one(spark, text.bag_of_words(F.col("x")), body) == bag == chunking._bag(body)


def test_one_failed_summary_disables_all(spark, tmp_path):
    units = spark.createDataFrame([(1, "good one"), (2, "  "), (3, "bad")], "chunk_id long, text string")
    short = lambda t: t[:4]
    kept = chunking.with_summaries(units, short, str(tmp_path / "a"), max_chars=3).collect()
    assert [(r["chunk_id"], r["summary"]) for r in sorted(kept)] == [(1, "goo"), (3, "bad")]

    def fails(t):
        if t == "bad":
            raise RuntimeError("no")
        return t

    none = chunking.with_summaries(units, fails, str(tmp_path / "b"))
    assert none.count() == 0 and none.columns == ["chunk_id", "text", "summary"]


def test_listing_puts_custom_docs_last(spark):
    counts = spark.createDataFrame([("b", 1, "ingested"), ("a", 1, "ingested"), ("z", 1, "custom"), ("y", 1, "custom")], "doc_id string, n_pages long, origin string")
    titles = spark.createDataFrame([("b", "B", 0), ("a", "A", 5), ("z", "alpha", 1)], "doc_id string, doc_title string, place long")
    assert [r["doc_id"] for r in catalog.catalog_listing(counts, titles).orderBy("nth").collect()] == ["b", "a", "z", "y"]
    rows = spark.createDataFrame([(1, "x"), (3, "y")], "updated_at long, v string")
    assert [r["v"] for r in catalog.listed(rows, "requests").collect()] == ["y", "x"]


def test_settings_are_seeded_at_every_level_and_prompts_chosen():
    assert catalog.merge_missing({"a": {"x": 1}, "b": 2}, {"a": {"x": 9, "y": {"z": 3}}, "b": {"q": 1}, "c": 4}) == {"a": {"x": 1, "y": {"z": 3}}, "b": 2, "c": 4}
    settings = {"system_prompt_templates": {"admin": "A", "client": " "}, "system_prompt_template": "S"}
    assert [catalog.system_prompt(settings, r) for r in ("admin", "client", "", "other")] == ["A", "S", "S", "S"]
    with pytest.raises(ValueError):
        catalog.system_prompt({"system_prompt_template": " "}, "x")


def test_cover_and_header_overrides(spark):
    front = "cover:\n  title: Inner\n  logo: l.png\n  text: ' '\ncover_title: ' Outer '\nguide_type: Manual\nheader_left: L\nheaders:\n  right: R"
    fields = text.front_matter_fields(F.col("x"))
    assert one(spark, text.overrides(fields, "cover", text.COVER_KEYS), front) == {"title": "Outer", "logo": "l.png", "type": "Manual"}
    assert one(spark, text.overrides(fields, "headers", text.HEADER_KEYS), front) == {"right": "R", "left": "L"}
    assert one(spark, text.overrides(fields, "cover", text.COVER_KEYS), "") == {}
    assert one(spark, text.sse_event(F.lit("delta"), F.col("x")), "hi") == "event: delta\ndata: hi\n\n"


def test_meta_and_readiness(spark):
    from graticule.operators.index import META, meta

    rows = chunks(spark, [(1, "d", "p", "alpha beta"), (2, "d", "p", "?!"), (3, "d", "q", "gamma")])
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "chunk_id long, vector array<float>")
    got = meta(rows, {"version": "v1"}, vectors, rows.limit(0))
    assert [r["key"] for r in got.collect()] == META and len(META) == 20
    facts = {r["key"]: r["value"] for r in got.collect()}
    assert (facts["version"], facts["n_chunks"], facts["avgdl"], facts["embedding_dim"], facts["summary_enabled"], facts["summary_avgdl"]) == ("v1", "2", "1.500000", "2", "0", "0")
    index = CorpusIndex.build(rows)
    assert index.ready() and not index.embeddings_ready() and index.summary_ready(rows) and not index.summary_ready(rows.where("chunk_id = 2"))


def test_a_datastore_is_read_back(spark, tmp_path):
    import json

    (tmp_path / "pages" / "d 1").mkdir(parents=True)
    (tmp_path / "pages" / "d 1" / "p1.md").write_text("# T\ntext")
    lines = [json.dumps({"doc_id": "d 1", "page_id": "p1"}), "{broken", json.dumps({"doc_id": "d 1"}), json.dumps({"doc_id": "d 1", "page_id": "gone"}), json.dumps({"doc_id": "", "page_id": "x"})]
    (tmp_path / "pages.jsonl").write_text("\n".join(lines))
    got = guides.read_datastore(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["page_id"], r["doc_title"], r["page_title"], r["markdown"]) for r in got] == [("d 1", "p1", "d 1", "p1", "# T\ntext")]


def test_table_lines_are_told(spark):
    rule = [one(spark, text.is_table_rule(F.col("x")), v) for v in ("|---|:---:|", "| -- |", "---", "|a|---|")]
    assert rule == [True, False, False, False]
    assert [one(spark, text.is_table_row(F.col("x")), v) for v in ("|a", "a|", "a|b|c", "a|b", "a")] == [True, True, True, False, False]


def test_each_form_of_a_text_is_computed_once(spark):
    """variants share their forms; a bag goes on past a step of words that add nothing to it; white space is that of before."""
    rows = spark.createDataFrame([("x",)], "x string")
    plan = rows.select(text.embedding_fallbacks(F.col("x")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("x00-") == 1 and plan.count("{2,}") == 1 and plan.count("{10,}") == 1
    many = " ".join(["same Same"] * 5 * text.WORDS + ["other", "SAME", "Other", "end"])
    assert one(spark, text.bag_of_words(F.col("x")), many) == "same other end"
    for value in (" \t  a  \x1c b　\x85\n", "  ", "a᠎ ", "", "a  b\tc \nd"):
        # the information separators and the wide blanks of the pattern are Python's white space
        assert one(spark, text.strip(F.col("x")), value) == value.strip()
        assert one(spark, text.rstrip(F.col("x")), value) == value.rstrip()
        assert one(spark, text.squeeze(F.col("x")), value) == " ".join(value.split())
    kept = one(spark, text.embedding_fallbacks(F.col("x")), " 12345678901 \n 123456789 12\n　1\n")
    assert {v["name"]: v["text"] for v in kept}["drop_short_lines"] == " 123456789 12"
