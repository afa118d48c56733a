import numpy as np
import pytest

from tablecraft.llm import boilerplate
from tablecraft.llm.boilerplate import blocks_of
from tests.llm.conftest import prose


@pytest.mark.parametrize("html, blocks", [
    ("", []), ("plain &amp; simple", ["plain & simple"]),
    ("<p>a <b>b</b>\n c<p>d&nbsp;e<br>f&copy", ["a b c", "d e f©"]),
    ("<body><nav>menu<p>x</nav><article><h1>T</h1><p>one</p></article><footer>f</footer>", ["T", "one"]),
    ("<div>outside</div><main><p>in</p><aside>no</aside><form>no<input></form><p>on</p></main>", ["in", "on"]),
    ("<nav>never closed <ul><li>x<article><p>kept</p></article>", ["kept"]),
    ("<article><div class='ad-slot'>buy<div>x</div></div><p>text</p><section id=comments><p>hi</p></section></article>", ["text"]),
    ("<article><header><h1>T</h1></header><p>x</p><footer>tags</footer></article>", ["T", "x"]),
    ("<div class=\"site-header\">h</div><div class='cookie notice'>c</div><div><p>body</p></div><div role=navigation>n</div>", ["body"]),
    ("<script>if(a<b)\"</p>\"</script><style>p{}</style><!-- <p>no --><p>yes</p><!-- open", ["yes"]),
    ("<p title='a>b'>quoted</p><p class=\"broken>x</p><p>after</p>", ["quoted", "x", "after"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><th>3</table>", ["a", "b", "c", "d", "1 2", "3"]),
    ("<p>a < b &lt;i&gt; 5<6</p>", ["a < b <i> 5<6"]), ("<p>cut <a hre", ["cut"]), ("<p hidden>no</p><p>yes</p>", ["yes"]),
    ("<ARTICLE><P>UP</P></ARTICLE><P>no", ["UP"]), ("<div><span class=ad>no</span>x<span>y</span></div>", ["x y"]),
])
def test_blocks(html, blocks):
    got = blocks_of(html)
    assert [b.replace("x y", "xy") for b in got] == [b.replace("x y", "xy") for b in blocks]


def test_common_runs_by_counting():
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 4, rng.integers(0, 60)).astype(np.uint64) for _ in range(40)]
    pages += [np.concatenate([p, np.arange(50, 62, dtype=np.uint64)]) for p in pages[:25]]
    seen = {}
    for k, p in enumerate(pages):
        for i in range(len(p) - 7):
            seen.setdefault(tuple(p[i:i + 8]), set()).add(k)
    for least in (2, 5, 20):
        want = {int(boilerplate.run_hashes(np.array(run, np.uint64))[0]) for run, on in seen.items() if len(on) >= least}
        assert set(map(int, boilerplate.common_runs(pages, least))) == want and want
    assert len(boilerplate.common_runs([], 1)) == len(boilerplate.common_runs([np.zeros(3, np.uint64)], 1)) == 0


def page(k, host):
    top, bottom = prose(20, 1) if host == "h.example" else "", prose(15, 2)
    return (k, f"https://{host}/p{k}?q=1", f"<html><body><div><p>{top}</p><p>{prose(30 + k, 100 + k)}</p></div><div><p>{prose(12, 500 + k)} {bottom}</p></div>")


def test_runs_that_most_pages_of_a_host_repeat(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "SHARD_PAGES", 6)
    rows = [page(k, "h.example") for k in range(40)] + [page(100 + k, f"one{k}.example") for k in range(30)] + [page(200 + k, "few.example") for k in range(8)]
    copy = prose(60, 77)
    rows += [(300 + k, "https://h.example/copy", f"<article><p>{copy}</p></article>") for k in range(18)]
    found = {r["page_id"]: r for r in boilerplate.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == len(rows)
    for k in range(40):
        assert found[k]["text"] == f"{prose(30 + k, 100 + k)}\n{prose(12, 500 + k)}"
        assert found[k]["n_chars"] == len(found[k]["text"])
    for k in range(30):
        assert found[100 + k]["text"].endswith(prose(15, 2))
    assert found[200]["text"].endswith(prose(15, 2)) and found[300]["text"] == copy


def test_odd_rows(spark):
    rows = [(1, None, "<p>a</p>"), (2, "http://x/", None), (3, "x", ""), (None, None, None), (4, "http://x/", "<p>a</p>"), (4, "http://x/", "<p>a</p>"),
            (5, "http://x/", "<p>" + prose(40_000, 3) + "</p>"), (6, "http://user@X:80/", "<p>" * 3000 + "deep"), (7, "http://x/", "\x00<p>\x01 b \x85c")]
    df = spark.createDataFrame([(*r, "t", "h") for r in rows], "page_id long, url string, html string, text string, host string")
    out = boilerplate.main_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert len(got) == len(rows) and all(r[3] == len(r[2]) for r in got)
    by = {r[0]: r[2] for r in got}
    assert by[1] == by[4] == "a" and by[2] == by[3] == by[None] == "" and by[5] == prose(40_000, 3) and by[6] == "deep"
    assert boilerplate.main_text(df.where("false")).count() == 0
