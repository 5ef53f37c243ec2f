import pytest

from loomline.functions.markdown import markdown_to_html

CASES = [
    ("# One\n## Two ##\n#### Four\n#no", "<h1>One</h1>\n<h2>Two</h2>\nFour\n<p>#no</p>"),
    ("Title\n===\n\nSub\n---\ntext", "<h1>Title</h1>\n<h2>Sub</h2>\n<p>text</p>"),
    ("a\n\n***\n- - -\nb", "<p>a</p>\n<hr>\n<hr>\n<p>b</p>"),
    ("1. one\n2. two\n\n7) seven", '<ol>\n<li>one</li>\n<li>two</li>\n</ol>\n<ol start="7">\n<li>seven</li>\n</ol>'),
    ("- a\n  - b\n  - c\n- d", "<ul>\n<li>a\n<ul>\n<li>b</li>\n<li>c</li>\n</ul>\n</li>\n<li>d</li>\n</ul>"),
    ("- a\n\n- b", "<ul>\n<li>\n<p>a</p>\n</li>\n<li>\n<p>b</p>\n</li>\n</ul>"),
    ("> q\nlazy\n> > deep", "<blockquote>\n<p>q\nlazy</p>\n<blockquote>\n<p>deep</p>\n</blockquote>\n</blockquote>"),
    ("```py\nx < 1\n\n# no\n```\nafter", "<pre><code>x &lt; 1\n\n# no\n</code></pre>\n<p>after</p>"),
    ("    code\n      more\n\nx", "<pre><code>code\n  more\n</code></pre>\n<p>x</p>"),
    ("_em_ __st__ *a **b** c* ***both*** snake_case_name 2*3*4", "<p><em>em</em> <strong>st</strong> <em>a <strong>b</strong> c</em> <em><strong>both</strong></em> snake_case_name 2<em>3</em>4</p>"),
    ("a  \nb\\\nc\nd", "<p>a<br>\nb<br>\nc\nd</p>"),
    ("`a*b*` ``x ` y`` \\*no\\* &copy; &lt;", "<p><code>a*b*</code> <code>x ` y</code> *no* © &lt;</p>"),
    ('[x](http://a.b "t") [bad](javascript:alert(1)) <http://c.d> ![i](p.png)', '<p><a href="http://a.b" title="t" rel="noopener noreferrer">x</a> <a rel="noopener noreferrer">bad</a> <a href="http://c.d" rel="noopener noreferrer">http://c.d</a> </p>'),
    ("[Ref] and [this][ref] and [none]\n\n[ref]: /u 'T'", '<p><a href="/u" title="T" rel="noopener noreferrer">Ref</a> and <a href="/u" title="T" rel="noopener noreferrer">this</a> and [none]</p>'),
    ("<b>x</b> <i onclick=1>y</i> <script>bad()</script><u>z</u>", "<p><b>x</b> <i>y</i> z</p>"),
    ("<div>\n*raw*\n</div>\n\n<b>open", "\n*raw*\n\n<p><b>open</b></p>"),
    ("a*b **c", "<p>a*b **c</p>"),
    ("", ""),
]


@pytest.mark.parametrize("source,want", CASES)
def test_blocks_and_marks(source, want):
    assert markdown_to_html(source) == (want and want + "\n")


@pytest.mark.parametrize("source", [">" * 3000 + "x", "- " * 3000, "*" * 20_000, "[" * 20_000, "`" * 9_999 + " a", "*a " * 20_000, "x" * 200_000, "<b>" * 3_000, "a\n" * 20_000])
def test_hostile_texts_end(source):
    out = markdown_to_html(source)
    assert out.count("<p>") == out.count("</p>")
