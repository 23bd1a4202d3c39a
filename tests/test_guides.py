"""Guides with titles and images: from HTML files to chunks, and back from a written datastore."""

import pytest
from pyspark.sql import functions as F

from graticule.functions import html
from graticule.operators import chunking
from graticule.sources import guides

PAGE = """<html><head><title>no</title></head><body><p id="pagetitle">The <b>First</b> Page</p><div id="mainbody">
<h2>Start</h2><p>Before the picture <img src="./img/a.png" alt="A pic"> after it.</p>
<p>Out and back <img src="../My Guide/img/a.png"></p><p>Deep <img src="sub/../img/b.png" alt="B"></p>
<p>Other guide <img src="../Other/img/a.png" alt="no"></p><p>Missing <img src="img/none.png" alt="no"></p>
<p>Absolute <img src="/img/a.png"></p><p>Web <img src="https://x.org/i.png" alt="w"> embedded <img src="data:image/png;base64,AA" alt="E"></p>
<table class="hs-box"><tr><td class="hs-box-icon"><img src="img/tip.png"></td><td class="hs-box-content">Look</td></tr></table>
</div></body></html>"""


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "guides"
    for guide in ("My Guide", "Other"):
        (root / guide / "img").mkdir(parents=True)
        (root / guide / "img" / "a.png").write_bytes(b"png of " + guide.encode())
    (root / "My Guide" / "img" / "b.png").write_bytes(b"b")
    (root / "My Guide" / "img" / "tip.png").write_bytes(b"t")
    (root / "My Guide" / "first.html").write_text(PAGE)
    (root / "My Guide" / "second.html").write_text("<body><p>No title here</p></body>")
    (root / "My Guide" / "unlisted.html").write_text("<body><p>Nobody sees this</p></body>")
    toc = "".join(f'<table class="TableOfContents"><td><a class="__tocentry" href="{h}">{n}</a></td></table>' for h, n in (("second.html", "Second"), ("first.html#x", "First"), ("gone.html", "Gone")))
    (root / "My Guide" / "__tableofcontents.html").write_text(toc)
    (root / "Other" / "__hidden.html").write_text("<p>no</p>")
    (root / "Other" / "z.html").write_text('<body><h1 id="pagetitle">Zed</h1><img src="img/a.png"><img src="img/a.png" alt="twice"></body>')
    return root


def pages_of(spark, folder):
    return {r["page_id"]: r for r in guides.read_guides(spark, str(folder), "v7").collect()}


def test_titles_and_order(spark, folder):
    got = pages_of(spark, folder)
    assert {k: (r["doc_id"], r["page_title"], r["heading_path"], r["place"]) for k, r in got.items()} == {
        "second": ("my-guide", "second", ["My Guide", "Second"], 0),
        "first": ("my-guide", "The First Page", ["My Guide", "First"], 1),
        "z": ("other", "Zed", ["Other", "Zed"], 0),
    }
    assert got["first"]["markdown"].startswith("# The First Page\n")


def test_images_get_addresses(spark, folder):
    first = pages_of(spark, folder)["first"]
    base = "/assets/v7/my-guide"
    assert [(i["original"], i["url"], i["alt"]) for i in first["images"]] == [("img/a.png", f"{base}/img/a.png", "A pic"), ("../My Guide/img/a.png", f"{base}/../My Guide/img/a.png", ""), ("sub/../img/b.png", f"{base}/sub/../img/b.png", "B")]
    text = first["markdown"]
    for shown in (f"![A pic]({base}/img/a.png)", f"![B]({base}/sub/../img/b.png)", "![no](../Other/img/a.png)", "![no](img/none.png)", "![](/img/a.png)", "![w](https://x.org/i.png)", "[Image: E]", "**Tip:** Look"):
        assert shown in text
    assert [i["alt"] for i in pages_of(spark, folder)["z"]["images"]] == ["", "twice"]


def test_page_asset_chunk_round_trip(spark, folder, tmp_path):
    """Every image that a chunk names can be fetched from the written assets by its address."""
    pages = guides.read_guides(spark, str(folder), "v7")
    guides.write_datastore(pages, str(tmp_path / "store" / "v7"))
    back = guides.read_datastore(spark, str(tmp_path / "store" / "v7"))
    columns = [c for c in back.columns if c in pages.columns]
    assert sorted(map(str, back.select(*columns).collect())) == sorted(map(str, pages.select(*columns).collect()))
    assert set(pages.columns) - set(columns) == {"place"}
    assert guides.versions(spark, str(tmp_path / "store")) == ["v7"]
    assets = guides.copy_assets(spark, str(folder), str(tmp_path / "store" / "assets"), pages)
    held = {r["url"]: bytes(r["content"]) for r in assets.collect()}
    assert len(held) == 4 and held["/assets/v7/my-guide/img/a.png"] == b"png of My Guide" and held["/assets/v7/other/img/a.png"] == b"png of Other"
    named = {r["u"] for r in chunking.chunk_pages(back).select(F.explode("images").alias("u")).collect()}
    assert named == set(held)
    everything = guides.copy_assets(spark, str(folder), str(tmp_path / "all"))
    assert everything.where("asset = 'My Guide/img/tip.png'").first()["length"] == 1


def test_a_catalogue_in_several_files_keeps_its_records(spark, folder, tmp_path):
    pages = guides.read_guides(spark, str(folder)).repartition(3)
    guides.write_datastore(pages, str(tmp_path / "s"))
    guides.write_datastore(pages.where("doc_id = 'other'"), str(tmp_path / "s"))
    assert [r["page_id"] for r in guides.read_datastore(spark, str(tmp_path / "s")).collect()] == ["z"]


def test_paths_as_a_stack(spark):
    """Against a plain stack of names, for all short paths of a few names."""
    import itertools

    def plain(guide, ref):
        if ref.startswith("/"):
            return None
        stack = [guide]
        for name in ref.split("/"):
            if name in ("", "."):
                continue
            if name == ".." and stack and stack[-1] != "..":
                stack.pop()
            else:
                stack.append(name)
        return "/".join(stack) if len(stack) > 1 and stack[0] == guide else None

    refs = ["/".join(p) for n in range(1, 6) for p in itertools.product(["..", ".", "G", "a", ""], repeat=n)]
    rows = spark.createDataFrame([("G", r) for r in refs], "guide string, ref string")
    got = {r["ref"]: r["to"] for r in rows.select("ref", guides.resolved(F.col("guide"), F.col("ref")).alias("to")).collect()}
    assert got == {r: plain("G", r) for r in refs}


def test_parts_of_a_page():
    title, parts, images = html.html_page('<body>\0x\0 1\0<p>a<img src="1.png" alt="i"><img src="2.png"></p><img src=""></body>', "n")
    assert title == "n" and images == [("1.png", "i"), ("2.png", "")]
    assert parts == ["# n\n\nx 1\n\na", "", "\n"]
    assert html.html_page("", "n") == ("n", ["# n\n"], [])


def test_no_texts_in_the_join_of_images(spark, folder):
    """What meets the listing of files are addresses: the listing's join has no page text on either side."""
    references = spark.createDataFrame([("G", "a.png", 1)], "guide string, original string, n int")
    plan = guides.resolve_images(references, guides.list_assets(spark, str(folder)))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("FileScan")[-1] if "FileScan" in plan else True
