"""Elements and sections of HTML against a plain Python stack for each name."""

import random
import re

from weftline.functions.html import BEGINS, ENDS
from weftline.operators import elements as E

LABELS = {"degrees": ["Degrees"], "email": ["Email", "E-mail"], "awards": ["Awards"]}


def plain_tokens(html):
    out = []
    for place, text in enumerate(re.findall(E.TOKEN, html or "")):
        tag = re.match(r"</?([A-Za-z][A-Za-z0-9]*)", text)
        name = tag.group(1).lower() if tag else None
        if text.startswith("<!") or name in E.HIDDEN:
            continue
        kind = "text" if name is None else "close" if text.startswith("</") else "void" if name in E.VOID or text.endswith("/>") else "open"
        out.append((place, kind, name, text))
    return out


def plain_elements(html):
    tokens = plain_tokens(html)
    open_, spans = {}, {}
    for place, kind, name, _ in tokens:
        stack = open_.setdefault(name, [])
        if kind == "open":
            stack.append(place)
            spans[place] = [name, None]
        elif kind == "close" and stack:
            spans[stack.pop()][1] = place
    out = set()
    whole = [(b, e) for b, (_, e) in spans.items() if e is not None]
    for begin, (name, end) in spans.items():
        closed = end is not None
        if not closed:
            end = next((p for p, k, n, _ in tokens if n == name and p > begin and k in ("open", "close")), tokens[-1][0] + 1)
            end = min([end, *(e for b, e in whole if b < begin < e)])
        out.add((name, begin, end, closed))
    return {(n, b, e, sum(b2 < b < e2 for _, b2, e2, _ in out), c) for n, b, e, c in out}


def plain_sections(html):
    line, items, parts, last, rows = 0, 0, [], None, []

    def flush():
        text = re.sub(r"\s+", " ", "".join(parts)).strip()
        if text:
            rows.append((text, inside))
        parts.clear()

    inside = False
    for _, kind, name, text in plain_tokens(html):
        if name == "li":
            items = max(0, items + (kind == "open") - (kind == "close"))
        if name in BEGINS | ENDS:
            flush()
        if kind == "text":
            if not parts:
                inside = items > 0
            parts.append(text)
    flush()
    names = {v: k for k, vs in LABELS.items() for v in vs}
    found, now = {}, None
    for text, listed in rows:
        if text in names:
            now = names[text] if names[text] not in found else "again"
            found.setdefault(now, [])
        elif now:
            found[now].append((text, listed))
    found.pop("again", None)
    return {k: [t for t, x in v if x] or [t for t, _ in v] for k, v in found.items()}


PAGES = [
    "<div><h3>Degrees</h3><ul><li>Ph.D., A<li>M.S., B</ul><h3> Email </h3><p><a href='mailto:x'>x@y.z</a></p>tail</div>",
    "<p>one<p>two</p></p></p><b>bold<i>both</b>it</i><br/><img src=x>",
    "<h2>Awards</h2>first<br>second <b>bold</b><br>Degrees<div>a</div><h2>Awards</h2><p>not these</p>",
    "<!-- <p> --><script>if (a < b) '</p>'</script><style>p{}</style><P CLASS='x'>A < B</P>",
    "<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul></li></ul>",
    "",
    None,
    "no tags",
    "</p></p><p>",
]


def random_page(rng):
    parts = []
    for _ in range(rng.randint(0, 60)):
        name = rng.choice(["p", "li", "ul", "b", "DIV", "h3", "br", "td"])
        parts.append(rng.choice([f"<{name}>", f"</{name}>", f"<{name} a='1'>", "word ", "Degrees", "E-mail", " x\n y ", "<!-- c -->", f"<{name}/>"]))
    return "".join(parts)


def test_same_as_stacks(spark):
    rng = random.Random(1)
    pages = dict(enumerate(PAGES + [random_page(rng) for _ in range(200)]))
    found = E.tokens(spark.createDataFrame(list(pages.items()), "page_id bigint, html string"), "page_id", "html")
    got = {}
    for r in E.elements(found).collect():
        got.setdefault(r["id"], set()).add((r["name"], r["begin"], r["end"], r["depth"], r["closed"]))
    for i, html in pages.items():
        assert got.get(i, set()) == plain_elements(html), html
    under = {}
    for r in E.sections(found, E.named(LABELS)).collect():
        under.setdefault(r["id"], {})[r["label"]] = r["items"]
    for i, html in pages.items():
        assert under.get(i, {}) == plain_sections(html), html


def test_texts_of_elements(spark):
    found = E.tokens(spark.createDataFrame([(1, PAGES[0]), (2, PAGES[3])], "page_id bigint, html string"), "page_id", "html")
    got = {(r["id"], r["name"], r["text"]) for r in E.element_texts(E.elements(found), found).filter("name IN ('li', 'a', 'p', 'h3')").collect()}
    assert got == {(1, "li", "Ph.D., A"), (1, "li", "M.S., B"), (1, "a", "x@y.z"), (1, "p", "x@y.z"), (1, "h3", "Degrees"), (1, "h3", "Email"), (2, "p", "A < B")}
