"""Main text of HTML pages from flat text blocks and a decision tree.

A page falls into flat blocks: the text between the tags that begin or end a paragraph, heading, item or
other box.  A block is described by its number of words and its link density, those of the blocks
before and behind it, and by the kind of place it stands in: an article or main part, a menu, header, footer, aside or form, a box
whose class, id or role names an advert, a notice, comments and the like, or none of these.  A decision tree, trained by
``pyspark.ml`` on the labelled blocks of ``LABELLED``, tells main text from the rest.  It becomes one
CASE expression, so that choosing and joining blocks is done in the row, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import beside_text

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
SILENT = frozenset("script style template noscript noframes iframe object svg math canvas audio video head title textarea select option datalist rp".split())
#: Elements that a new one of the same group ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Where such an implied end stops looking.
SCOPES = frozenset("table ul ol dl body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav aside footer form button fieldset label dialog menu address".split())
ASIDE_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words of a class or id that name a box beside the main text, those of readers' comments, and those of the main text.
BESIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners sidebar sidebars widget widgets nav navbar navigation menu menus submenu breadcrumb breadcrumbs "
    "pagination pager footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations trending popular outbrain taboola byline author tags taglist toc disclaimer copyright legal skip hidden".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond reply replies disqus discussion reviews guestbook".split())
MAIN_WORDS = frozenset("article articlebody post postbody entry story content maincontent main body text".split())
MODIFIERS = frozenset("has with without no free is".split())
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

FEATURES = ("n_words", "link_density", "words_before", "links_before", "words_behind", "links_behind", "heading", "item", "place", "sentence", "in_main_page")
_BLOCKS = "array<struct<text: string, f: array<double>>>"
_BLOCK_TYPE = pa.list_(pa.struct([("text", pa.string()), ("f", pa.list_(pa.float64()))]))
#: Kinds of place: beside the main text by an element, by a name, none known, named like main text, an article or main element.  An article in a
#: box that is beside by its name is main text only of a page without any other.
BESIDE, NAMED_BESIDE, UNKNOWN, NAMED_MAIN, IN_MAIN = -2.0, -1.0, 0.0, 1.0, 2.0
ARTICLE_BESIDE = -0.5


def _names(attrs: dict[str, str | None]) -> tuple[bool, bool, bool]:
    """Whether a class, or the id, speaks of comments, of a box beside the main text, and of main text; ``has-sidebar`` and the like say nothing."""
    names = [{w.lower() for w in _WORD.findall(name)} for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split()]
    names = [n for n in names if not n & MODIFIERS]
    beside = [n & BESIDE_WORDS for n in names]
    return any(n & COMMENT_WORDS for n in names), any(beside), any(n & MAIN_WORDS for n, b in zip(names, beside, strict=True) if not b)


def _place(tag: str, attrs: dict[str, str | None], above: tuple[float, bool]) -> tuple[float, bool]:
    """The kind of place inside an element, and whether it is within comments, from those around it."""
    place, comments = above
    of_comments, beside, main = _names(attrs) if tag not in ("html", "body") else (False, False, False)
    role = (attrs.get("role") or "").lower()
    comments = comments or of_comments
    if comments or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style") or ""):
        return BESIDE, comments
    if tag == "main" or role == "main":
        return IN_MAIN, False
    if place == BESIDE or tag in ASIDE or role in ASIDE_ROLES or (tag == "header" and place < NAMED_MAIN):
        return BESIDE, False
    if tag == "article" or role == "article" or "articleBody" in (attrs.get("itemprop") or ""):
        return (IN_MAIN if place >= UNKNOWN else ARTICLE_BESIDE), False
    if beside:
        return NAMED_BESIDE, False
    return (NAMED_MAIN if main and place == UNKNOWN else place), False


class Blocks(HTMLParser):
    """Flat blocks of a page: (text, words, words in links, heading, item, place), without those that have no word."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, tuple[float, bool]]] = []
        self.open: Counter[str] = Counter()
        self.silent = self.links = 0
        self.found: list[tuple[str, int, int, bool, bool, float]] = []
        self.pieces: list[tuple[str, bool]] = []
        self.at: tuple[str, float] | None = None

    def flush(self) -> None:
        if self.pieces:
            words = "".join(t for t, _ in self.pieces).split()
            if words and self.at:
                linked = sum(len(t.split()) for t, in_link in self.pieces if in_link)
                tag, place = self.at
                self.found.append((" ".join(words), len(words), min(linked, len(words)), tag in HEADINGS, tag in ("li", "dt", "dd", "td", "th"), place))
        self.pieces, self.at = [], None

    def pop(self, tags: set[str] | frozenset[str]) -> None:
        """End the elements down to the innermost one of ``tags``."""
        while self.stack:
            tag, _ = self.stack.pop()
            self.open[tag] -= 1
            self.silent -= tag in SILENT
            self.links -= tag == "a"
            if tag in tags:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.pieces.append((" ", self.links > 0))
            return
        if tag not in INLINE:
            self.flush()
            if self.open["p"]:
                self.pop({"p"})
            if tag in ENDS:
                for name, _ in reversed(self.stack):
                    if name in SCOPES:
                        break
                    if name in ENDS[tag]:
                        self.pop(ENDS[tag] if tag != "tr" else {"tr"} if self.open["tr"] else ENDS[tag])
                        break
        elif tag == "a" and self.links:
            self.pop({"a"})
        if tag in VOID:
            return
        above = self.stack[-1][1] if self.stack else (UNKNOWN, False)
        self.stack.append((tag, above if tag in INLINE else _place(tag, dict(attrs), above)))
        self.open[tag] += 1
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as in browsers, a slash ends no element but a void one

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.pieces.append((" ", self.links > 0))
        elif tag not in VOID:
            if tag not in INLINE:
                self.flush()
            if self.open[tag]:
                self.pop({tag})

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.pieces.append((data, self.links > 0))
            if self.at is None and not data.isspace():
                boxes = ((t, p[0]) for t, p in reversed(self.stack) if t not in INLINE)
                self.at = next(boxes, ("body", UNKNOWN))


def flat_blocks(html: str) -> list[dict]:
    """text and f, the values of ``FEATURES``, of each block of a page."""
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    has_main = any(b[5] == IN_MAIN for b in parser.found)
    lifted = NAMED_BESIDE if has_main else IN_MAIN
    found = [(*b[:5], lifted if b[5] == ARTICLE_BESIDE else b[5]) for b in parser.found]
    in_main = float(any(b[5] == IN_MAIN for b in found))
    around = [(0, 0.0), *[(n, linked / n) for _, n, linked, *_ in found], (0, 0.0)]
    out = []
    for i, (text, n, _, heading, item, place) in enumerate(found):
        before, own, behind = around[i : i + 3]
        values = [n, own[1], *before, *behind, heading, item, place, text[-1] in ".!?:;\"'”’»…)", in_main]
        out.append({"text": text, "f": [float(v) for v in values]})
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # a page at a time
            blocks = flat_blocks(batch.column(batch.num_columns - 1)[i].as_py() or "")
            yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(i, 1) for j in range(batch.num_columns - 1)), pa.array([blocks], _BLOCK_TYPE)], [*batch.schema.names[:-1], "blocks"])


def _filled(page: str) -> str:
    """``{n}`` is n words of filler that end in a full stop, ``[n]`` a link of n words without one."""
    page = re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * int(m[1])) + ".", page)
    return re.sub(r"\[(\d+)\]", lambda m: "<a href=x>" + " ".join(["link"] * int(m[1])) + "</a>", page)


_MENU = "<ul><li>[1]</li><li>[1]</li><li>[2]</li></ul>"
#: The labelled table: pages in short (see ``_filled``), and for each of their flat blocks in turn 1 for main text or 0.
LABELLED = (
    (f"<nav>{_MENU}</nav><div class=ad>{{9}}</div><article><h1>title of it</h1><p>{{40}}<p>{{70}}<p>{{1}}<p>{{3}}</p></article><footer>{{7}}</footer>", "000" "0" "1" "1111" "0"),
    (f"<nav>{_MENU}</nav><div class=ad>{{30}}</div><article><h1>title</h1><p>{{2}}</p><p>[3]</p><ul><li>{{4}}</li><li>{{12}}</li></ul></article><footer>{{25}} [2]</footer>", "000" "0" "1" "11" "11" "0"),
    (f"<header><h1>Site name</h1><nav>{_MENU}</nav></header><main><h1>title here</h1><p>{{55}} [3]</p><h2>part</h2><p>{{8}}</p><p>[2] {{4}}</p></main><aside><h3>see also</h3>{_MENU}</aside><footer><p>{{60}}</p></footer>", "0" "000" "11111" "0" "000" "0"),
    ("<div class=cookie-banner><p>{35}</p></div><article><header><h1>title of a page</h1></header><p>{90}</p><blockquote>{14}</blockquote><aside>{20}</aside><p>{33}</p><footer>{6}</footer></article><section class=comments><h2>3 comments</h2><p>{45}</p><p>{30}</p></section>", "0" "11101" "0" "000"),
    ("<article><h1>a title</h1><p>{30}</p><form><p>{12}</p><button>send it</button></form><p>{5}</p><div class=share>[1] [1]</div></article><div id=comments><article class=comment><p>{50}</p></article></div>", "11" "00" "1" "0" "0"),
    (f"<div class=top>{_MENU}</div><div class=content><h1>title words</h1><p>{{44}}</p><p>{{2}}</p><p>{{61}}</p></div><div class=sidebar><p>{{25}}</p>{_MENU}</div><div class=footer>{{9}}</div>", "000" "1111" "0000" "0"),
    (f"<div id=menu>{_MENU}</div><div class=post><h2>title</h2><p>{{20}}</p><p>{{38}} [4]</p><ul><li>{{6}}</li><li>{{9}}</li></ul></div><div class=promo>{{32}}</div><div class=newsletter><p>{{15}}</p></div><p>{{5}}</p>", "000" "11111" "0" "0" "0"),
    (f"<div>{_MENU}</div><div><h1>title of it</h1></div><div><p>{{48}}</p><p>{{65}}</p><p>{{22}}</p><p>{{39}}</p></div><div>{_MENU}</div><div>copyright of us</div>", "000" "1" "1111" "000" "0"),
    (f"<table><tr><td>{_MENU}</td><td><p>{{52}}</p><p>{{31}}</p><p>{{12}}</p><p>{{44}}</p></td></tr></table><div>[2] [2] [3]</div><div>all rights kept</div>", "000" "1111" "0" "0"),
    (f"<div>[1] | [1] | [1] | [2]</div><h1>some title here</h1><p>{{28}}</p><h2>part</h2><p>{{57}} [2]</p><p>{{19}}</p><div>[3] [3]</div><div>[2]</div><div>{{4}}</div>", "0" "11111" "0" "0" "0"),
    ("<div>[6]</div><div>[5]</div><div>[7]</div><div>{3} [4]</div><p>{75}</p><p>{66}</p><p>{24}</p><div>[4]</div><div>[5]</div><div>{2} [6]</div>", "0000" "111" "000"),
    (f"<main><div class=breadcrumbs>[1] [1]</div><h1>title</h1><div class=body><p>{{33}}</p><pre>{{11}}</pre><table><tr><td>{{3}}</td><td>{{2}}</td></tr></table></div><div class=related>{_MENU}</div></main><p>{{18}}</p>", "0" "1" "1111" "000" "0"),
    ("<body><div role=banner>{8}</div><div role=main><p>{26}</p><p>{4}</p></div><div role=complementary><p>{40}</p></div><div role=contentinfo>{13}</div>", "0" "11" "0" "0"),
    ("<div>[12]</div><div>[9] [8]</div><h2>title</h2><p>{60}</p><p>{3}</p><p>{72}</p><p>{6}</p><p>{40} [3]</p><p>{2}</p><p>{31}</p><div>[15]</div><div>{12} [10]</div>", "00" "11111111" "00"),
    ("<div>[4] [4] [5]</div><div>[14]</div><h1>title of it</h1><p>{45}</p><p>{4}</p><p>{4}</p><p>{53}</p><div>[16]</div><div>{3}</div><div>[4]</div>", "00" "11111" "000"),
    ("<div>{3}</div><div>{12} [14]</div><p>{58}</p><p>{7} [2]</p><p>{47}</p><p>{5}</p><p>{60}</p><div>[18]</div><div>[11] {2}</div>", "00" "11111" "00"),
    ("<div class=notice><h4>a notice</h4><p>{12}</p></div><article><h1>title</h1><p>{21}</p></article><h3>more to read</h3><div>[5]</div><h3>about us</h3><div>{26}</div>", "00" "11" "0000"),
    ("<div class=site-notice><h2>note</h2>{6}</div><div class=entry><h2>title</h2><p>{9}</p><p>{64}</p></div><div class=widget><h3>read on</h3><p>[2]</p></div>", "00" "111" "00"),
    ("<p>{80}</p><p>{35}</p><p>{41}</p>", "111"),
    ("<div><p>{16}</p><p>{11}</p><p>{27}</p></div>", "111"),
    ("<article><p>{1}</p></article><div>{22}</div><div>{70}</div>", "1" "0" "0"),
    ("<div class=notice>{50}</div><div class=alert><div class=cookie>{28}</div></div><article><h1>one</h1><div>{17}</div><div>[2]</div></article><div class=ads>{44}</div>", "00" "111" "0"),
)


def tree_column(node, f: Column) -> Column:
    """The prediction of a trained tree's node for an array of features."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    left, right = (tree_column(child, f) for child in (node.leftChild(), node.rightChild()))
    return F.when(F.get(f, F.lit(split.featureIndex())) <= split.threshold(), left).otherwise(right)


def fit(spark: SparkSession, labelled=LABELLED, max_depth: int = 6):
    """The tree of the labelled pages."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.functions import array_to_vector

    if any(len(flat_blocks(_filled(page))) != len(label) for page, label in labelled):
        raise ValueError("a page's blocks and labels differ in number")
    pages = spark.createDataFrame([(label, _filled(page)) for page, label in labelled], "label string, html string").coalesce(1)
    rows = pages.mapInArrow(_parse, f"label string, blocks {_BLOCKS}").select(F.posexplode("blocks").alias("i", "b"), "label")
    rows = rows.select(array_to_vector("b.f").alias("features"), F.substring("label", F.col("i") + 1, F.lit(1)).cast("double").alias("y"))
    return DecisionTreeClassifier(featuresCol="features", labelCol="y", maxDepth=max_depth, maxBins=64, seed=1).fit(rows)


def extract_text(pages: DataFrame, model=None, *, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of each row (all but the html if None), text and n_chars: the main text's blocks in page order, with a blank line between them.

    A null or empty page, one without a block of main text, and text outside of any tag that is too short are an empty text.  White space
    in a block, no-break spaces too, is one space.  A kept column may not be named like an output.
    """
    keep = [c for c in pages.columns if c != html_col] if keep is None else keep
    given = beside_text(pages, keep, html_col, ["text", "n_chars"])
    model = model or fit(pages.sparkSession)
    root = model._call_java("rootNode")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), f"blocks {_BLOCKS}"])
    blocks = given.mapInArrow(_parse, schema)
    chosen = F.filter("blocks", lambda b: tree_column(root, b["f"]) == 1.0)
    out = blocks.withColumn("blocks", F.array_join(F.transform(chosen, lambda b: b["text"]), "\n\n")).toDF(*keep, "text")
    return out.withColumn("n_chars", F.length("text").cast("long"))
