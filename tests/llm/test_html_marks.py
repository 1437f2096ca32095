"""Reading the marks of pages: broken ones, values of attributes, and time."""

import time

import pytest

from stockbook.llm.html_text import extract, parsed


@pytest.mark.parametrize("unit", ["<a ", '<a b="', "<a b='", "<!--", "<?", "<!", "</", "</a", "<", "<a b='>", "<a a", "<![", "<a =", "<a b = ", "<!-- -", "<a/b='", "&", "<script", "<script>", "<p class=\"x' ", "x<b "])
@pytest.mark.parametrize("tail", ["", ">", "-->", '">'])
def test_a_megabyte_of_broken_marks(unit, tail):
    began = time.process_time()
    parsed(unit * (1_000_000 // len(unit)) + tail)
    assert time.process_time() - began < 5


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a<b>b</b> c", "ab c"), ("<p>1 < 2 & 3 > 2</p>", "1 < 2 & 3 > 2"), ("<p title='a>b' class=x/>t</p>", "t"), ("<p title=it's>t</p><p>u</p>", "t u"), ("<p>a<!-- <p>no</p> -->b</p>", "ab"), ("<p>a<!-->b</p>", "ab"),
        ("<p>a<!--x--!>b</p>", "ab"), ("<p>a<!-- open", "a"), ("<p>a<b", "a"), ('<p>a<b title="', "a"), ("<p>a</p", "a"), ("<p>a<![CDATA[x]]>b", "ab"), ("<p>a<!x>b<?y z?>c</>d</ e>f", "abcdf"), ("<script>if (a<b) '</p>' </script><p>x</p>", "x"),
        ("<script/><p>x</p>", "x"), ("<style>p</STYLE ><p>x</p>", "x"), ("<script>open <p>x</p>", ""), ("<P CLASS=Nav>no</P><p>&eacute;&#x41;&amp;lt;</p>", "éA&lt;"), ("<div class='a' class=\"nav\">x</div>y", "y"), ("<a b='><p>x</p>", "x"), ("<p c=\"x>y</p>", "y"), ("< p>x", "< p>x"), ("<3 x", "<3 x"), ("a<br/>b<br>c", "a b c"), ("", ""), (None, ""),
    ],
)
def test_marks(html, text):
    assert extract(html, None) == text
