"""Labelled pages: what stands before the article, the article, and what stands after it.

Each is laid out by one of several page designs and holds one of several kinds of article, with boilerplate of many
forms around it. The marked region is the article; nothing names it but its place.
"""

from __future__ import annotations

import random
from collections.abc import Callable

_SAID = (
    "The council met on Tuesday evening and agreed, after two hours of debate, to repair the old bridge before the winter comes.",
    "Residents had asked for the work since the spring floods, when the river rose above the road and left three villages without a way across.",
    "Nobody will miss the old deck, said the mayor, and everybody will miss the old toll.",
    "The first stage closes one lane for about a month, and the second replaces the timber deck and both handrails.",
    "In the survey of the piers divers found two cracks, neither of them deep, and a good deal of driftwood.",
    "Bread needs time more than it needs work: a slow night in the cold gives the crumb its taste and the crust its colour.",
    "Set the oven as hot as it goes, let the stone take the heat for an hour, and only then turn out the dough.",
    "To read the file in parts, open it with a buffer, and hand each part to the parser before the next one is read.",
    "The figures for the year are lower than those of the year before, though not by much, and the last quarter was the best of all.",
    "She had walked the coast for eleven days when the weather broke, and there was nothing for it but to wait in the hut.",
    "Most of the birds leave in September; a few, mostly the old ones, stay near the harbour and live on what the boats leave.",
    "It is not known who built the wall, or why, but the stones came from the other side of the valley.",
)
_TERMS = ("Home", "News", "Sport", "About us", "Contact", "Shop", "Archive", "Weather", "Jobs", "Travel", "Log in", "Help", "Imprint", "Privacy", "More", "Next", "Older posts", "Top", "Read on", "Subscribe")
_NOTES = ("All rights reserved", "Share this", "Posted in general", "3 comments", "Advertisement", "Follow us", "Today", "Site by nobody", "You may also like", "5 min read")


def _terms(rng: random.Random, n: int) -> list[str]:
    return [f'<a href="/{rng.randrange(99)}">{rng.choice(_TERMS)}</a>' for _ in range(n)]


_MENUS: tuple[Callable[[random.Random], str], ...] = (
    lambda r: "<ul>" + "".join(f"<li>{a}</li>" for a in _terms(r, r.randint(3, 9))) + "</ul>",
    lambda r: "<div>" + " | ".join(_terms(r, r.randint(2, 6))) + "</div>",
    lambda r: "<table><tr>" + "".join(f"<td>{a}</td>" for a in _terms(r, r.randint(3, 6))) + "</tr></table>",
    lambda r: "<div>" + "".join(f"<div><span>{a}</span></div>" for a in _terms(r, r.randint(2, 5))) + "</div>",
    lambda r: f"<div><img src='x.png'><span>{r.choice(_NOTES)}</span></div>",
    lambda r: "<dl>" + "".join(f"<dt>{a}</dt><dd>{r.choice(_NOTES)}</dd>" for a in _terms(r, r.randint(2, 4))) + "</dl>",
    lambda r: f"<div><h3>{r.choice(_NOTES)}</h3><ul>" + "".join(f"<li>{a}<br><small>{r.choice(_NOTES)}</small></li>" for a in _terms(r, r.randint(2, 5))) + "</ul></div>",
    lambda r: f"<div><input type=text><button>{r.choice(_TERMS)}</button></div>",
)


def _paragraph(r: random.Random) -> str:
    said = [r.choice(_SAID) for _ in range(r.randint(1, 4))]
    if r.random() < 0.3:
        at = r.randrange(len(said))
        first, _, rest = said[at].partition(" ")
        said[at] = f"<{'b' if r.random() < 0.5 else 'i'}>{first}</{'b' if r.random() < 0.5 else 'i'}> {rest}"
    if r.random() < 0.3:
        said.append(f'See <a href="/plan">{r.choice(_SAID)[:30]}</a> for it.')
    return " ".join(said)


_ARTICLES: tuple[Callable[[random.Random], str], ...] = (
    lambda r: f"<h1>{r.choice(_SAID)[:40]}</h1>" + "".join(f"<p>{_paragraph(r)}</p>" for _ in range(r.randint(3, 9))),
    lambda r: "".join(f"<p>{_paragraph(r)}" for _ in range(r.randint(2, 6))),
    lambda r: f"<h2>{r.choice(_SAID)[:30]}</h2>" + "<br><br>".join(_paragraph(r) for _ in range(r.randint(3, 6))),
    lambda r: f"<h1>{r.choice(_SAID)[:40]}</h1><p>{_paragraph(r)}</p><ul>" + "".join(f"<li>{r.choice(_SAID)}</li>" for _ in range(r.randint(2, 6))) + f"</ul><p>{_paragraph(r)}</p>",
    lambda r: "".join(f"<div><p>{_paragraph(r)}</p></div>" for _ in range(r.randint(2, 6))),
    lambda r: f"<p>{_paragraph(r)}</p><blockquote><p>{r.choice(_SAID)}</p></blockquote><p>{_paragraph(r)}</p><h2>{r.choice(_SAID)[:25]}</h2><p>{_paragraph(r)}</p>",
    lambda r: f"<p>{_paragraph(r)}</p><pre>open(name)\nread(part)</pre><p>{_paragraph(r)}</p><ol>" + "".join(f"<li>{r.choice(_SAID)}</li>" for _ in range(3)) + "</ol>",
    lambda r: f"<h1>{r.choice(_SAID)[:40]}</h1><p>{_paragraph(r)}</p><table>" + "".join(f"<tr><td>{r.choice(_SAID)[:20]}</td><td>{r.randrange(999)}</td></tr>" for _ in range(4)) + f"</table><p>{_paragraph(r)}</p><figure><img src=a><figcaption>{r.choice(_SAID)}</figcaption></figure><p>{_paragraph(r)}</p>",
)

_WRAPS = (("", ""), ("<div>", "</div>"), ("<div><div>", "</div></div>"), ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>"), ("<div id=c><div><div>", "</div></div></div>"))


def labelled(number: int = 64, seed: int = 1) -> list[tuple[str, str, str]]:
    out = []
    for k in range(number):
        r = random.Random(seed * 1000 + k)
        before = "<!DOCTYPE html><html><head><title>T</title></head><body>" + "".join(r.choice(_MENUS)(r) for _ in range(r.randint(1, 4)))
        after = "".join(r.choice(_MENUS)(r) for _ in range(r.randint(1, 5))) + "</body></html>"
        left, right = _WRAPS[k // len(_ARTICLES) % len(_WRAPS)]
        out.append((before + left, _ARTICLES[k % len(_ARTICLES)](r), right + after))
    return out


PAGES = labelled()
