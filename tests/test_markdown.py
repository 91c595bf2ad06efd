from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import markdown as M


def test_html():
    md = M.html_to_markdown("<h2>T</h2><script>x()</script><p>a<br>b &amp; c</p><table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>x<br>y</td></tr></table><!-- no --><img src='p.png' alt='pic'><ul><li>one</li></ul>")
    assert "## T" in md and "x()" not in md and "a\nb & c" in md and "| 1 | x；y |" in md and "![pic](p.png)" in md and "- one" in md and "no" not in md
    assert M.html_to_markdown(None) == ""


def test_blocks():
    text = "---\ntitle: x\n---\n# A **b**\n\npara one\nstill one\n\n```python\n# not a heading\n```\n\n```plain\nprose\n```\n\n| h | k |\n|---|---|\n| 1 | a |\n|  | b |\n\n> quote\n\n- i1\n- i2\n\n![alt](x.png)\n\n#tag #other\n\n# A b\n"
    got = [(b["kind"], b["text"]) for b in M.blocks_of(text)]
    assert got == [("frontmatter", "title: x"), ("heading", "A b"), ("text", "para one still one"), ("code", "# not a heading"), ("text", "prose"), ("table", "h：1；k：a\nh：1；k：b"), ("quote", "quote"), ("list", "- i1\n- i2"), ("image", "alt"), ("heading", "A b")]
    assert [b["anchor"] for b in M.blocks_of(text) if b["kind"] == "heading"] == ["a-b", "a-b-1"]
    assert M.blocks_of(None) == [] and M.blocks_of("") == []


def test_chunk_headings_and_kinds():
    c = M.chunks_of("# A\n\n" + "Prose. " * 30 + "\n\n## B\n\n```\ncode\n```\n\n![i](p.png)\n\ntail\n\n# C\n\nend")
    assert [(x["kind"], x["heading_path"]) for x in c] == [("text", "A"), ("text", "A > B"), ("image", "A > B"), ("code", "A > B"), ("text", "C")]
    assert [x["seq"] for x in c] == list(range(5))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "句子。", "Long sentence here. ", "\n\n", "# H\n", "- item\n", "x" * 150, "，", "| a | b |\n", "```\n", "é"]), max_size=60))
def test_chunks_are_bounded_and_keep_words(parts):
    text = "".join(parts)
    chunks = M.chunks_of(text, most=200, least=20)
    assert all(len(c["text"]) <= 200 for c in chunks)
    assert M.chunks_of(text, most=200, least=20) == chunks


def test_fit_is_lossless():
    text = "一句话。" * 400 + "x" * 5000
    assert "".join(M.fit(text, 300)) == text and max(map(len, M.fit(text, 300))) <= 300


def test_failures_are_isolated(spark):
    df = spark.createDataFrame([(1, "# A\n\ntext"), (2, None), (3, "")], "doc_id long, text string")
    got = M.chunk_documents(df).collect()
    assert [(r["doc_id"], r["chunk"], r["error"]) for r in got] == [(1, "text", None)]
