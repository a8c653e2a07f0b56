"""Pages as trees: tags become nodes with features, texts become leaves; and labelled pages drawn from layout rules."""

from __future__ import annotations

import html
import random
import re
import zlib
from dataclasses import dataclass, field

BUCKETS = 4096
EDGES = 256

# How elements nest in the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp script small span strike strong style sub sup template time tt u var wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset(("title", "textarea"))
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: What an opening tag closes, up to the nearest of the bounds.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "thead": ({"tr", "tbody", "thead"}, {"table"}), "tbody": ({"tr", "tbody", "thead"}, {"table"}), "body": ({"head"}, {"html"})}

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)"""
    r"""|<(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:=\s*+(?:"[^"]*"|'[^']*')|[^>])*+)(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Parts of class names and ids that tell what an element is for.
HINTS = tuple("advert sponsor promo banner comment cookie consent sidebar menu navig breadcrumb footer header masthead widget share social related recommend newsletter subscri popup modal notice alert login signup search toolbar pagination copyright disclaimer article content story entry post main body".split())


@dataclass
class Page:
    """Nodes in page order: ``parent`` (-1: none), ``depth``, the features ``at[cuts[n]:cuts[n + 1]]``, the edge type, and the texts.

    ``texts`` has for each text leaf its node, its decoded text, and whether a block boundary stands before it.
    """

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    cuts: list[int] = field(default_factory=lambda: [0])
    edge: list[int] = field(default_factory=list)
    texts: list[tuple[int, str, bool]] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)

    def add(self, parent: int, kind: str, features: list[str], label: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.at += [_bucket(f) for f in features]
        self.cuts.append(len(self.at))
        self.edge.append(_bucket("edge " + kind) % EDGES)
        self.labels.append(label)
        return len(self.parent) - 1


_buckets: dict[str, int] = {}


def _bucket(feature: str) -> int:
    found = _buckets.get(feature)
    if found is None:
        if len(_buckets) > 100_000:
            _buckets.clear()
        found = _buckets[feature] = zlib.crc32(feature.encode()) % BUCKETS
    return found


def _element_features(tag: str, rest: str, parent: str) -> tuple[list[str], int | None]:
    found, label = ["tag " + tag, f"under {parent} {tag}", "element"], None
    if rest and not rest.isspace():
        for m in _ATTRIBUTE.finditer(rest):
            name = m[1].lower()
            value = m[2] or m[3] or m[4] or ""
            if name in ("class", "id", "role", "itemprop", "aria-label"):
                low = value.lower()
                for part in set(_NAME.findall(value)):
                    found.append("name " + part.lower())
                found += ["hint " + h for h in HINTS if h in low]
            elif name == "data-content":
                label = int(value == "1")
            elif name in ("hidden", "aria-hidden") and value != "false" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                found.append("hidden")
    return found, label


def _text_features(text: str, parent: str, linked: bool) -> list[str]:
    n = len(text.split())
    found = ["text", "text in " + parent, f"words {min(n, 3) if n < 4 else 3 + n.bit_length()}"]
    if linked:
        found.append("linked")
    if text.rstrip()[-1:] in ".!?:;":
        found.append("sentence")
    return found


def parse(source: str | None) -> Page:
    """The tree of a page, however badly it nests: unclosed elements end with their parents, what was cut off at its end is left out."""
    source, page = source or "", Page()
    root = page.add(-1, "root", ["root"], 0)
    # The open elements: tag, node, label, whether inside a link, and what their names tell those directly inside.
    stack: list[tuple[str, int, int, bool, list[str]]] = [("", root, 0, False, [])]
    is_open: dict[str, int] = {}  # how many of each tag, so that deep pages are not searched for what is not open
    at, broken = 0, True

    def close(i: int) -> None:
        for tag, *_ in stack[i:]:
            is_open[tag] -= 1
        del stack[i:]

    def text(raw: str) -> None:
        nonlocal broken
        if not raw:
            return
        tag, node, label, linked, names = stack[-1]
        if raw.isspace():
            page.texts.append((-1, " ", broken))
        else:
            decoded = html.unescape(raw)
            leaf = page.add(node, "text in " + tag, _text_features(decoded, tag, linked) + names, label)
            page.texts.append((leaf, decoded, broken))
        broken = False

    while at < len(source):
        m = _TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if m["tag"]:
            tag = m["tag"].lower()
            if tag in CLOSES_P and is_open.get("p"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] == "p":
                        close(i)
                        break
                    if stack[i][0] in ("button", "table", "td", "th", "caption", "object", "template"):
                        break
            if tag in IMPLIED and any(is_open.get(t) for t in IMPLIED[tag][0]):
                closes, bounds = IMPLIED[tag]
                lowest = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in bounds:
                        break
                    if stack[i][0] in closes:
                        lowest = i
                if lowest:
                    close(lowest)
            broken |= tag not in INLINE
            over, parent, inherited, linked, names = stack[-1]
            features, label = _element_features(tag, m["rest"], over)
            inside = ["in " + f for f in features if f.startswith(("name ", "hint "))]
            label = inherited if label is None else label
            node = page.add(parent, f"{over} {tag}", features + names, label)
            if tag in VOID or m["rest"].endswith("/") and tag not in INLINE | CLOSES_P:
                continue
            if tag in RAW or tag in RCDATA:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
                own = source[at : end.start() if end else len(source)]
                if tag in RCDATA:
                    stack.append((tag, node, label, linked, inside))
                    text(own)
                    stack.pop()
                at = end.start() if end else len(source)
                continue
            stack.append((tag, node, label, linked or tag == "a", inside))
            is_open[tag] = is_open.get(tag, 0) + 1
        elif m["end"]:
            tag = m["end"].lower()
            broken |= tag not in INLINE
            for i in range(len(stack) - 1, 0, -1) if is_open.get(tag) else ():
                if stack[i][0] == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i][0] in CLOSES_P or stack[i][0] == "table" != tag:
                    break  # an inline end tag does not close blocks around it
    return page


# Names of page parts in the labelled pages.
BOILER = {
    "nav": ("menu navigation navbar topnav main-nav nav-links breadcrumb breadcrumbs pagination pager toc tabs site-nav mega-menu", "nav ul div"),
    "header": ("header site-header masthead page-header top-bar topbar branding logo hero-banner", "header div"),
    "footer": ("footer site-footer page-footer bottom colophon copyright legal credits footer-links", "footer div"),
    "side": ("sidebar side-bar aside widget widgets rail right-rail secondary left-column related related-posts related-articles recommended more-stories trending popular tags author-box", "aside div section"),
    "notice": ("notice cookie-notice cookie banner cookie-banner consent gdpr alert announcement disclaimer paywall popup modal overlay newsletter subscribe subscription signup warning message", "div section aside"),
    "ad": ("ad ads advertisement advert ad-slot ad-container adsbygoogle sponsored sponsor promo promotion promoted banner-ad dfp partner affiliate", "div aside section ins"),
    "form": ("form search search-form login login-form contact-form subscribe-form signup-form poll", "form"),
    "comments": ("comments comment user-comments comment-list comments-area discussion responses replies disqus reader-comments comment-thread reactions", "section div ol"),
    "share": ("share social share-buttons social-links sharing share-bar toolbar follow-us", "div ul"),
}
GOOD = "content article article-body article-content post post-content post-body entry entry-content story story-body main main-content text body-text prose blog-post page-content".split()


def labelled_pages(count: int, seed: int = 42) -> list[str]:
    """Labelled pages: layouts drawn by rule, each part with ``data-content`` 1 or 0.  Texts of either kind are long and short alike."""
    rng = random.Random(seed)
    syllables = [a + b for a in ["", *"bdfglmnprstv"] for b in ("a", "e", "i", "o", "u", "an", "er", "is", "on")]

    def words(low: int, high: int) -> str:
        found = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(low, high))]
        return (" ".join(found).capitalize() + rng.choice([".", ".", ".", "!", "?", "", ":", " |", "%%%"])).replace("&", "&amp;")

    def links(n: int) -> str:
        return "".join(rng.choice(["<li>{}</li>", "{}", "<span>{}</span>"]).format(f'<a href="/{i}">{words(1, 4)}</a>') for i in range(n))

    def boiler(kind: str | None = None) -> str:
        kind = kind or rng.choice(list(BOILER))
        names, tags = BOILER[kind]
        tag = rng.choice(tags.split())
        name = rng.choice(rng.choice([names.split(), names.split()[:4]]))
        own = rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} {rng.choice(["x1", "wide", "clearfix", "left"])}"', f' role="{name}"'])
        if tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5:
            own = ""
        parts = rng.choices(["links", "p", "long", "bare", "bare", "head", "input", "quote"], k=rng.choice([1, 1, 2, 3, 4]))
        inside = {
            "links": lambda: f"<ul>{links(rng.randint(1, 8))}</ul>",
            "p": lambda: f"<p>{words(1, 12)}</p>",
            "long": lambda: f"<p>{words(15, 90)}</p>" * rng.randint(1, 2),
            "bare": lambda: words(1, 15),
            "head": lambda: f"<h{rng.randint(1, 4)}>{words(1, 5)}</h{rng.randint(2, 4)}>",
            "input": lambda: f'<label>{words(1, 3)}</label><input type="text"><button>{words(1, 2)}</button>' if kind != "ad" else f'<a href="/buy"><img src="a.png">{words(1, 6)}</a>',
            "quote": lambda: rng.choice(['<div><b>{}</b> <blockquote>{}</blockquote></div>', '<p><b>{}</b> {}</p>', '<article class="comment"><h4>{}</h4><p>{}</p></article>', '<li class="comment"><b>{}</b><p>{}</p></li>']).format(words(1, 2), words(3, 40)) if kind == "comments" else f"<div><span>{words(1, 10)}</span></div>",
        }
        return f'<{tag}{own} data-content="0">{"".join(inside[p]() for p in parts)}</{tag}>'

    def block() -> str:
        text = words(*rng.choice([(1, 3), (3, 12), (10, 40), (30, 120)]))
        if rng.random() < 0.3:
            cut = text.split(" ")
            i = rng.randrange(len(cut))
            cut[i] = rng.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/x">{}</a>', "<i>{}</i>", "<code>{}</code>", "<span>{}</span>", "<strong>{}</strong>"]).format(cut[i])
            text = " ".join(cut)
        many = [words(1, 15) for _ in range(rng.randint(1, 5))]
        items = "".join(f"<li>{m}</li>" for m in many)
        kinds = [f"<p>{text}</p>"] * 8 + [f"<p><b>{text}<br>", f"<h2>{words(1, 8)}</h2>", f"<h3>{words(1, 8)}</h3>", f"<ul>{items}</ul>", f"<ol>{items}</ol>", f"<blockquote><p>{text}</p></blockquote>", f"<blockquote>{text}</blockquote>", f"<pre>{text}</pre>", "<table>" + "".join(f"<tr><td>{m}</td><td>{words(1, 4)}</td></tr>" for m in many) + "</table>", f"<figure><img src=a.png><figcaption>{text}</figcaption></figure>", f"<div>{text}</div>", f"<section><h2>{words(1, 6)}</h2><p>{text}</p></section>", text + "<br>", f"<dl><dt>{words(1, 3)}</dt><dd>{text}</dd></dl>"]
        return rng.choice(kinds)

    def page() -> str:
        blocks = [block() for _ in range(rng.randint(1, 14))]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            blocks.insert(rng.randint(0, len(blocks)), boiler())
        if rng.random() < 0.3:
            blocks.append(boiler("comments"))
        title = words(1, 10)
        head = f"<h1>{title}</h1>" if rng.random() < 0.8 else ""
        tag, own = rng.choice([("article", ""), ("article", ""), ("article", ""), ("article", f' class="{rng.choice(GOOD)}"'), ("main", ""), ("div", f' class="{rng.choice(GOOD)}"'), ("div", f' id="{rng.choice(GOOD)}"'), ("section", f' class="{rng.choice(GOOD)}"')])
        body = f'<{tag}{own} data-content="1">{head}{"".join(blocks)}</{tag}>'
        if rng.random() < 0.08:  # no element of its own holds the article
            body = "".join(re.sub(r"^<(\w+)(?! data| class| id| role)", r'<\1 data-content="1"', b if b.startswith("<") else f"<p>{b}</p>") for b in [head or block(), *blocks])
            body = re.sub(r'data-content="1"([^>]*data-content="0")', r"\1", body)
        before = [boiler(rng.choice(["nav", "header", "notice", "ad", "form", None])) for _ in range(rng.randint(0, 4))]
        after = [boiler(rng.choice(["footer", "side", "comments", "ad", "share", None])) for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.3:
            wrap = rng.choice(['<div id="wrapper">{}</div>', '<div class="container"><div class="row">{}</div></div>', "<main>{}</main>", '<div class="page">{}</div>', '<div id="content">{}</div>'])
            body = wrap.format("".join(before[1:]) + body + "".join(after[:1]))
            before, after = before[:1], after[1:]
        hidden = rng.choice(["", "", f'<div style="display:none" data-content="0">{words(2, 20)}</div>', f'<p hidden data-content="0">{words(2, 9)}</p>', f'<noscript data-content="0">{words(2, 9)}</noscript>'])
        return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{"".join(before)}<!-- x -->{hidden}{body}{"".join(after)}</body></html>'

    return [page() for _ in range(count)]
