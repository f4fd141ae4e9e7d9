"""Main text of web pages by the maximum-scoring subsequence of words and tags (operator 6).

A page is a sequence of words and tags.  Each has a score from the labelled pages below: the log of how much more
often its kind stands inside the article than outside; words of running text come out positive, tags negative, words
of links and of page furniture negative.  What is furniture is learned too, from the names of the elements around a word
(tags, words of classes and ids, roles).  One linear scan finds the contiguous stretch with the greatest sum.  Where
that stretch lies in an element that is marked as the article, the whole element is taken; furniture inside (adverts,
forms, reader comments) is left out.

Null and empty pages, and pages without text, give an empty text.  Repeated rows give repeated rows, an empty table an
empty one.  Of stretches with equal sums the first counts.  Pages of any length are read whole, in time linear in it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pageforge.llm.common import pick, slices, table

#: Labelled pages; the article stands between [[ and ]], what does not belong to it although it stands inside between {{ and }}.
LABELLED = (
    "<html><head><title>A day</title></head><body><nav><ul><li><a href='/'>Home</a></li><li><a>News</a></li><li><a>About</a></li></ul></nav><article>[[<h1>A day at the coast</h1><p>We left early in the morning and drove along the shore for hours.</p><p>The wind was strong, and the sea was <b>very</b> rough that day, as <a href='/sea'>those who know the sea</a> had told us.</p><p>In the evening we came back tired but happy.</p>]]</article><footer>Copyright by us, all rights reserved</footer></body></html>",
    "<body><div class='menu'><a>One</a><a>Two</a><a>Three</a><a>Four</a></div><div class='ad'>Buy two shoes now</div><div id='content'>[[<h2>How bread is made</h2><p>Flour, water, salt and time are all that it takes to make good bread.<br>Knead the dough for ten minutes.</p><ul><li>Let it rest for a night</li><li>Bake it hot</li></ul><p>Leave it to cool before you cut it, if you can wait that long.</p>]]</div><div class='sidebar'><a>Most read</a><a>Latest</a><p>Follow us today</p></div></body>",
    "<body><header><a>Logo</a><form><input name='q'><button>Search all our pages</button></form></header><main>[[<h1>On rivers</h1><p>Rivers shape the land through which they flow, slowly and without rest.</p><blockquote>No one steps twice into the same river, as an old saying has it.</blockquote><p>They carry sand and stones down to the sea.</p>]]</main><div id='comments'><h3>Comments</h3><div class='comment'><p>I liked this one a lot, thanks for it.</p><a>Reply</a></div></div><footer><a>Imprint</a><a>Privacy</a></footer></body>",
    "<body><table><tr><td><a>Start</a></td><td><a>Archive</a></td><td><a>Contact</a></td></tr></table><div>[[<p>The town council met on Monday to talk about the new bridge, which will cost more than planned.</p><p>Work is to begin in spring and to end two years later, said the mayor.</p>]]</div><div><a>Back</a> | <a>Print</a> | <a>Mail</a></div><p class='notice'>This site of ours uses cookies</p></body>",
    "<body><div class='cookie-banner'>We use cookies to serve you better. <button>Accept them all now</button></div><div class='post'>[[<h1>Notes</h1><p>First, the good news: it works, and it works well enough for daily use.</p><pre>make all</pre><p>Then the bad news: it is slow, and nobody knows why that is so.</p>]]</div><aside><h4>Related</h4><ul><li><a>Other notes</a></li><li><a>Older notes</a></li></ul></aside></body>",
    "<body><table><tr><td><a>Start page</a></td><td><a>New here</a></td></tr><tr><td><a>Books and films</a></td><td><a>House and garden</a></td></tr><tr><td><a>Food and wine</a></td><td><a>Cars and bikes</a></td></tr><tr><td><a>All our writers</a></td><td><a>All our letters</a></td></tr></table><div>[[<h1>Snow in May</h1><p>It snowed on the second of May, on blossom and on early peas alike.</p><p>By noon it had gone, and by night nobody spoke of it any more.</p>]]</div><ul><li><a>Hail in June</a></li><li><a>A dry July</a></li><li><a>The storm of the year</a></li><li><a>More about weather</a></li><li><a>Ask the weather man</a></li><li><a>Send us your pictures</a></li></ul></body>",
    "<body><ul><li><a>Sport</a></li><li><a>Politics</a></li><li><a>Weather</a></li><li><a>Travel</a></li><li><a>Letters to us</a></li><li><a>Jobs and homes</a></li><li><a>Births and deaths</a></li><li><a>From the archive</a></li><li><a>Photos of the week</a></li></ul><article>[[<h1>Rain</h1><p>It rained.</p><p>It rained for a week, and the streets were full of water up to the knee.</p>]]</article><div class='share'><a>Share it</a><a>Tweet it</a><a>Mail it</a></div><footer><p>Legal notice and terms of use apply</p></footer></body>",
    "<body><div class='topbar'>Call us any day of the week</div><div class='masthead'><p>The Daily Post, since 1901</p></div><div class='breadcrumb breadcrumbs'><a>Home page</a> / <a>World news</a></div><div class='story'>[[<h1>A long road</h1><p>The road over the pass was closed for the winter, and so we had to wait for spring.</p>{{<div class='advert adsense'>Winter tyres at half the price</div>}}<p>When the snow had gone we set out again with two mules and little food:</p><ol><li>a sack of flour that had been wet once</li><li>beans and a side of bacon</li><li>coffee for the first three days at best</li></ol>]]</div><div class='recommended recommendations'><p>You may also want to read these</p></div></body>",
    "<body><div role='navigation'><a>Start page</a><a>Our shop</a><a>Find us</a></div><div role='banner'><p>Welcome to our pages</p></div><div role='main' class='body'>[[<h1>Bees</h1><p>A hive may hold more than fifty thousand bees in summer, and far fewer in winter.</p><h3>How they live through the winter</h3><p>They keep warm by moving close together around the queen.</p><table><tr><th>Month</th><th>Bees in the hive</th></tr><tr><td>June is the best of all months</td><td>fifty thousand bees or even more</td></tr><tr><td>January is the worst of them</td><td>ten thousand at the most</td></tr></table>{{<div class='newsletter subscribe'><p>Sign up for our weekly letter</p></div>}}<p>In spring the first of them fly out to look for flowers.</p>]]</div><div role='complementary'><p>More about insects here</p></div><div role='contentinfo'><p>All content is ours</p></div></body>",
    "<body><div class='consent gdpr'><p>We value your privacy and ask for your consent</p></div><div class='navbar'><a>Log in</a><a>Log out</a><a>Your page</a></div><div class='entry'>[[<p>My grandmother baked on Fridays. The smell of it filled the whole house and the yard behind.</p><p>None of us has her recipe, and none of our loaves is like hers.</p>]]</div><div class='respond'><p>Leave a word for the author</p></div><div class='replies reply'><p>So true, mine did just the same</p></div><div class='disqus discussion'><p>Join the talk below the line</p></div></body>",
    "<body><div class='popup modal overlay'><p>Get ten percent off your first order</p></div><div class='toolbar'><a>Make bold</a><a>Print page</a><a>Read aloud</a></div><section class='article'>[[<h1>Stone walls</h1><p>Dry stone walls need no mortar; the weight of the stones holds them in place.</p><h4>What the old masters say about it</h4><p>A good builder never puts down a stone that is once in the hand; see <a>the book on walls</a> and <a>the one on gates and stiles</a> for more.</p>]]</section><div class='widget widgets'><p>Weather: sunny, nine degrees</p></div><div class='sponsor sponsored sponsors'><p>Brought to you by a bank</p></div></body>",
    "<body><div class='promo promotion promoted'><p>This week only: two for one</p></div><div class='text'>[[<h2>The old mill</h2><p>The mill by the brook has stood still for forty years, and birds nest in its wheel.</p><p>Now a young couple wants to make it run once more.</p>{{<div class='related teaser'><p>Also read: the brook that came back</p></div>}}<p>They have saved for six years and still lack half of the money.</p>]]</div><div class='pagination pager'><a>1</a><a>2</a><p>next page of ten</p></div><div class='copyright'><p>No copying without leave</p></div></body>",
    "<body><div role='search'><p>What are you looking for</p></div><div role='alert alertdialog'><p>The shop is closed today</p></div><div role='menubar'><a>Open file</a><a>Save file</a><a>Close all</a></div><div class='main'>[[<h1>Frost</h1><p>The frost came early that year and took the late apples with it.</p><p>People lit small fires between the trees to save what was left:</p><ul><li>the pears behind the old school house</li><li>the plums along the road to the mill</li><li>and the walnut on the green, which is older than any of us</li></ul>]]</div><div class='login signup'><p>Members log in here please</p></div><div class='social sharing'><p>Tell your friends about us</p></div><div class='outbrain taboola'><p>Ten tricks that doctors hate</p></div></body>",
    "<body><div class='alert alerts notices'><p>Our phones are out of order today</p></div><div class='subnav topnav navi'><a>One up</a><a>One down</a><a>To the top</a></div><article>[[<h1>The ferry</h1><p>The ferry crosses twice a day, at seven and at four, when the tide allows it.</p>{{<aside><p>Tickets can be had at the pier</p></aside>}}<p>On most days it carries post, bread and a few people who do not talk much.</p>]]</article><div class='footer foot'><p>Written and made in the north</p></div><div class='subscription'><p>Three months for the price of two</p></div></body>",
    "<body><div role='dialog'><p>Choose a language first</p></div><div role='toolbar'><p>Zoom in and out</p></div><div role='menu'><a>New file</a><a>Old files</a><a>All files</a></div><div role='form'><p>Fields with stars are needed</p></div><main>[[<h1>Two maps</h1><p>There are two maps of the valley, and they do not agree about where the river ends.</p><h3>Which of them to trust</h3><p>The older one is drawn with more care, yet the newer one is right.</p><h4>And where they can be seen</h4><p>Both hang in <a>the town hall</a>.</p>]]</main><div class='rail sidebars'><p>Trending in your town now</p></div><div class='ads adv adverts'><p>Cheap flights to the sun</p></div></body>",
    "<body><dialog><p>Your own session will end soon</p></dialog><menu><li>Copy this line</li><li>Paste it here</li></menu><div class='skip'><p>Skip to the main part</p></div><div class='cookies'><p>Cookies make this page work well</p></div><div class='content'>[[<h1>Salt</h1><p>Salt was once worth as much as silver, and whole towns grew rich from it.</p><p>The roads on which it was carried can still be walked today.</p><ul><li>The one from the north follows the river for nine days</li><li>The one from the east goes over two high passes</li><li>The one from the south is the shortest and the worst</li></ul>{{<form><label>Your mail address please</label><select><option>Every day at six</option><option>Once a week only</option></select></form>}}<p>Some of them are older than any church along the way.</p>]]</div><div class='navigation nav'><a>Older posts</a><a>Newer posts</a><a>All posts</a></div><svg><text>Logo text of the firm</text></svg></body>",
    "<body><div class='search form'><p>Type a word and press return</p></div><div class='banner'><p>Half price until Sunday night</p></div><div class='story'>[[<p>Nobody had seen the comet but the baker, who was up at three as always.</p><p>He told the others, who laughed, and the night after they saw it too.</p>]]</div><div class='comments'><p>I saw it as well that night</p></div><div class='menus'><p>Soup of the day is leek</p></div><div class='advertisement'><p>New glasses for less money</p></div><object>Your browser shows no film</object></body>",
)

RAW = frozenset("script style noscript template textarea iframe title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: The weight from which on an element's name (its tag, a word of its class or id, its role) makes it furniture.
FURNITURE = -2.0
ARTICLE = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z|[^<]++|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_WITH = re.compile(r"\b(?:has|no|with|without)[-_]\w+")


def _attributes(raw: str) -> tuple[set[str], str, bool]:
    """The words of class and id, the role, and whether the element is hidden."""
    names, role, hidden = set(), "", False
    for key, a, b, c in _ATTRIBUTE.findall(raw):
        key, value = key.lower(), a or b or c
        if key == "role":
            role = value.strip().lower()
        elif key == "hidden":
            hidden = True
        elif key == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
        else:
            names.update(w.lower() for w in _PART.findall(_WITH.sub(" ", value)))
    return names, role, hidden


def tokens(page: str, names: dict[str, float], around: list | None = None) -> list[tuple[str, str, str, int, bool, int]]:
    """(kind, tag or text, context, words, whether it parts blocks, number of the article element around it).

    Context of words: text, link, furniture.  Kinds: word (a run of text), open, close.  names: the weights of elements'
    names.  around gets, for each token, the names of the elements around it.
    """
    out = []
    stack: list[tuple[str, bool, bool, int, bool, tuple]] = []  # tag, furniture, link, article element, furniture that an article does not end, names
    depth: Counter = Counter()
    furniture, link, article, firm, held = start = (False, False, 0, False, ())
    articles = 0
    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or len(text) == 1:
                context = "furniture" if furniture else "link" if link else "text"
                out.append(("word", text, context, len(text.split()), False, article))
                if around is not None:
                    around.append(held)
            continue
        tag = tag.lower()
        parts = tag not in INLINE
        if m[1]:
            out.append(("close", tag, "", 0, parts, article))
            if around is not None:
                around.append(held)
            while depth[tag]:
                gone = stack.pop()[0]
                depth[gone] -= 1
                if gone == tag:
                    break
            furniture, link, article, firm, held = stack[-1][1:] if stack else start
            continue
        if parts and stack and (stack[-1][0] == "p" and tag not in VOID or stack[-1][0] == tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
            depth[stack.pop()[0]] -= 1
            furniture, link, article, firm, held = stack[-1][1:] if stack else start
        out.append(("open", tag, "", 0, parts, article))
        if around is not None:
            around.append(held)
        if tag in VOID:
            continue
        words, role, hidden = _attributes(m[3]) if m[3] else (set(), "", False)
        # Inline marks are part of the running text, and an article has a header of its own.
        own_names = [] if tag in INLINE or tag == "header" and article else [f"<{tag}>"]
        own_names += [f"role {r}" for r in role.split()]
        if tag not in ("html", "body", "h1", "header"):
            own_names += words
        if tag in ARTICLE:  # ends a menu or header that was left open
            articles += 1
            state = (tag, firm, False, articles, firm, held + tuple(own_names))
        else:
            bad = furniture or hidden or tag in RAW or any(names.get(n, 0.0) <= FURNITURE for n in own_names)
            own = article
            if not bad and not article and tag in ("div", "section", "td") and any(names.get(n, 0.0) >= -FURNITURE for n in words):
                articles += 1
                own = articles
            state = (tag, bad, link or tag == "a", own, firm or bad and not furniture and tag not in ("nav", "header", "head"), held + tuple(own_names) if around is not None else ())
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else size
        stack.append(state)
        depth[tag] += 1
        furniture, link, article, firm, held = state[1:]
    return out


_SIGNS = re.compile(r"\[\[|\]\]|\{\{|\}\}")


def _labelled(page: str, names: dict[str, float]) -> list[tuple[tuple, tuple, bool]]:
    """(token, names around it, whether it is of the article) of a labelled page."""
    plain, signs = "", []
    for part in re.split(r"(\[\[|\]\]|\{\{|\}\})", page):
        if _SIGNS.fullmatch(part):
            signs.append((len(plain), part))
        else:
            plain += part
    around: list = []
    found, at, inside, out = tokens(plain, names, around), 0, False, []
    for token, held in zip(found, around):
        while signs and signs[0][0] <= at:
            inside = signs.pop(0)[1] in ("[[", "}}")
        out.append((token, held, inside))
        m = _TOKEN.match(plain, at)
        at = m.end()
        if m[2] and not m[1] and m[2].lower() in RAW:
            end = re.compile(f"</{m[2]}", re.I).search(plain, at)
            at = end.start() if end else len(plain)
        while at < len(plain) and plain[at] == "<" and (m := _TOKEN.match(plain, at)) and m[2] is None and len(m[0]) > 1:
            at = m.end()
    return out


def weights(pages: tuple[str, ...] = LABELLED) -> tuple[dict[str, float], dict[str, float]]:
    """What the labelled pages teach: weights of elements' names, and scores by kind of token.

    A name weighs the log of how many words stand inside the article rather than outside under elements of that name.
    With these, words are text, link or furniture; their scores, and those of tags, are logs of how much more often they
    stand inside than outside.
    """
    inside, outside = Counter(), Counter()
    for page in pages:
        for (kind, _, _, n, _, _), held, own in _labelled(page, {}):
            if kind == "word":
                for name in set(held):
                    (inside if own else outside)[name] += n
    names = {k: math.log(inside[k] + 0.5) - math.log(outside[k] + 0.5) for k in {*inside, *outside}}
    inside, outside = Counter(), Counter()
    for page in pages:
        for (kind, what, context, n, _, _), _, own in _labelled(page, names):
            (inside if own else outside)[context if kind == "word" else what] += n if kind == "word" else 1
    total_in, total_out = sum(inside.values()), sum(outside.values())
    out = {k: math.log((inside[k] + 0.5) / (total_in + 1)) - math.log((outside[k] + 0.5) / (total_out + 1)) for k in {*inside, *outside, "other"}}
    # A tag that is frequent in articles is no text itself: no tag counts for the article.
    return names, {k: x if k in ("text", "link", "furniture") else min(x, 0) * 0.5 - 0.1 for k, x in out.items()}


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch of greatest sum, in one pass; (0, 0) if nothing is positive."""
    best, low, high = 0.0, 0, 0
    total, start = 0.0, 0
    for k, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += x
        if total > best:
            best, low, high = total, start, k + 1
    return low, high


def main_text(page: str, learned: tuple[dict[str, float], dict[str, float]]) -> str:
    names, score = learned
    seq = tokens(page, names)
    other = score["other"]
    low, high = best_stretch([score[c] * n if kind == "word" else score.get(what, other) for kind, what, c, n, _, _ in seq])
    if low == high:  # no running text: what links hold is better than nothing
        low, high = best_stretch([n if kind == "word" and c != "furniture" else -0.01 for kind, _, c, n, _, _ in seq])
    held = {x[5] for x in seq[low:high] if x[0] == "word" and x[3] and x[2] != "furniture"}
    if len(held) == 1 and (own := held.pop()):
        spots = [k for k, x in enumerate(seq) if x[5] == own]
        low, high = min(low, spots[0]), max(high, spots[-1] + 1)
    blocks, block = [], []
    for kind, what, context, _, parts, _ in seq[low:high]:
        if kind == "word":
            if context != "furniture":
                block.append(what)
        elif parts:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    clean = (" ".join(html.unescape(b).split()) if "&" in b else " ".join(b.split()) for b in blocks)
    return " ".join(b for b in clean if b)


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every whole page."""
    learned = weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                texts = [main_text(x, learned) if x else "" for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pick(df, page_id=page_id, url=url, html=markup).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
