"""Main text of pages written by hand, apart from the layouts that are fitted on."""

from __future__ import annotations

import html
import re

import numpy as np
import pytest

from palimpsest.llm import html_main
from palimpsest.llm.common import table

# fmt: off
P=["The old bridge over the river was built in 1874 by two brothers from the village. It has three arches of grey stone, and it carried the coach road until the war.",
"In the spring floods of 1921 the middle arch gave way. The council rebuilt it within a year, with stone from the same quarry, and put up a plaque.",
"Today only walkers and cyclists use it. Every summer a fair is held on the meadow below, where the trout fishers of the valley meet."]
B="".join(f"<p>{x}</p>" for x in P); T="\n".join(P)
C="<div class=u1><h3>2 comments</h3><div class=u2><b>Ann</b><p>Lovely piece, my grandfather worked on that bridge.</p></div><div class=u2><b>Bob</b><p>I was there last week and the plaque is gone now.</p></div></div>"
PAGES=[
("comments u1", f"<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><div class=k4><h1>Bridge</h1>{B}</div>{C}</body></html>", "Bridge\n"+T),
("comments in article", f"<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><article><h1>The old bridge</h1>{B}{C}</article><footer>&copy; Valley Post</footer></body></html>", "The old bridge\n"+T),
("unnamed footer", f"<body><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul><div><h1>The old bridge</h1>{B}</div><div>Copyright 2020 Acme Ltd. All rights reserved.</div></body>", "The old bridge\n"+T),
("unnamed footer p", f"<body><article><h1>The old bridge</h1>{B}</article><div><p>Copyright 2020 Acme Ltd. All rights reserved.</p></div></body>", "The old bridge\n"+T),
("header in article", f"<body><nav><a href=/>Home</a></nav><article><header><h1>Bridge</h1></header>{B}</article><footer>Imprint</footer></body>", "Bridge\n"+T),
("header in article, aside", f"<body><header><a href=/>Valley Post</a><nav><a href=/n>News</a><a href=/s>Sport</a></nav></header><main><article><header><h1>The old bridge of the valley</h1></header>{B}</article><aside><h2>Most read</h2><ul><li><a href=1>Fair cancelled</a><li><a href=2>New mayor</a></ul></aside></main></body>", "The old bridge of the valley\n"+T),
("unnamed divs", f"<body><div><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></div><div><h1>Bridge</h1>{B}</div><div>&copy; 2019 Valley Post</div></body>", "Bridge\n"+T),
("unnamed nested", f"<body><div><div><a href=/>Home</a><a href=/n>News</a></div><div><div><h1>The bridge</h1>{B}</div></div><div><p>(c) 2018 Valley Post</p></div></div></body>", "The bridge\n"+T),
("cookie", f"<body><div class=x9><p>We use cookies to make this site better for you.</p><button>Accept</button></div><main><h1>Bridge</h1>{B}</main><form><label>Search</label><input></form></body>", "Bridge\n"+T),
("german comments", f"<body><main><h1>Die Brücke</h1>{B}</main><section><h2>Kommentare</h2><ol><li><p>Karl:</p><p>Sehr schön geschrieben.</p></li><li><p>Uwe:</p><p>Danke dafür, das wusste ich nicht.</p></li></ol></section></body>", "Die Brücke\n"+T),
("sections", f"<body><header><h1>Valley Post</h1></header><article><h1>Bridge</h1><section><h2>Origin</h2><p>{P[0]}</p></section><section><h2>Flood</h2><p>{P[1]}</p></section><section><h2>Today</h2><p>{P[2]}</p></section></article></body>", f"Bridge\nOrigin\n{P[0]}\nFlood\n{P[1]}\nToday\n{P[2]}"),
("list", f"<body><nav><ul><li><a href=1>A</a><li><a href=2>B</a></ul></nav><article><h1>Bridge</h1><p>{P[0]}</p><ul><li>Three arches of grey stone</li><li>Coach road until the war</li></ul><p>{P[1]}</p></article></body>", f"Bridge\n{P[0]}\nThree arches of grey stone\nCoach road until the war\n{P[1]}"),
("short page", f"<body><nav><a href=1>A</a></nav><article><h1>Note</h1><p>Closed today.</p></article><footer>&copy; Post</footer></body>", "Note\nClosed today."),
("prose about comments", f"<body><article><h1>Comments on the budget</h1>{B}</article></body>", "Comments on the budget\n"+T),
("sponsored", f"<body><div class=q7><p>Sponsored: Buy the best boots in town</p></div><article><h1>Bridge</h1>{B}</article></body>", "Bridge\n"+T),
("long comments", f"<body><div class=a1><h1>Bridge</h1>{B}</div><div class=b2><h4>Comments</h4>"+"".join(f"<div><cite>Reader {i}</cite><p>{P[i%3]}</p></div>" for i in range(5))+"</div></body>", "Bridge\n"+T),
]

Q=["Wool from the upper farms was once carried over the pass on mules. The trade ended when the railway reached the lower town, and most of the stables fell empty.",
"Since then the path has been kept open by volunteers, who clear it of stones each May. They are paid nothing, but there is soup at the hut.",
"Anyone who walks it should allow six hours. Bring water: the spring below the summit dries up by July.",
"A map can be had at the station."]
R="".join(f"<p>{x}</p>" for x in Q); S="\n".join(Q)
OTHERS=[
("replies list", f"<html><body><div id=x1><a href=/>Start</a> | <a href=/m>Maps</a></div><div id=x2><h1>The mule path</h1>{R}</div><div id=x3><h2>Replies</h2><ul>"+"".join(f"<li><div>{w} <span>yesterday</span></div><p>{t}</p></li>" for w,t in (("Maria","We walked it in June and the spring was still running."),("Joe","Soup was great!"),("Kim","How steep is it?")))+"</ul></div></body></html>", "The mule path\n"+S),
("one comment", f"<body><header><a href=/>Hill Walks</a></header><main><h1>Mules</h1>{R}<div><h3>1 comment</h3><div><strong>Ole</strong><p>Thank you for this.</p></div></div></main></body>", "Mules\n"+S),
("footer in wrapper", f"<body><div class=w><div class=t><a href=/>Home</a><a href=/a>All walks</a></div><div class=c><h1>Mules</h1>{R}</div><div class=f>© 2023 Hill Walks. All rights reserved. <a href=/p>Privacy</a></div></div></body>", "Mules\n"+S),
("footer with links", f"<body><article><h1>Mules</h1>{R}</article><div><a href=/p>Privacy</a> <a href=/i>Imprint</a><p>Copyright Hill Walks 2001-2024</p></div></body>", "Mules\n"+S),
("header with subtitle", f"<body><nav><ul><li><a href=/>Home</a></ul></nav><article><header><h1>Mules</h1><p>A path and its keepers</p></header>{R}</article></body>", "Mules\nA path and its keepers\n"+S),
("headline in h2", f"<body><header><h1>Hill Walks</h1></header><div class=z><h2>Mules</h2>{R}</div><aside><h3>Weather</h3><p>Rain later.</p></aside></body>", "Mules\n"+S),
("spanish", f"<body><nav><a href=/>Inicio</a></nav><article><h1>El camino</h1>{R}</article><section><h3>Comentarios</h3><article><b>Luz</b><p>Muy bonito.</p></article><article><b>Paco</b><p>Fui en mayo y todo estaba muy bien cuidado.</p></article></section><footer>Todos los derechos reservados</footer></body>", "El camino\n"+S),
("login form", f"<body><form action=/l><label>Name</label><input><label>Password</label><input type=password><button>Log in</button></form><div class=story><h1>Mules</h1>{R}</div></body>", "Mules\n"+S),
("subscribe inside", f"<body><article><h1>Mules</h1><p>{Q[0]}</p><form><p>Get our letter</p><input><button>Subscribe</button></form><p>{Q[1]}</p><p>{Q[2]}</p></article></body>", f"Mules\n{Q[0]}\n{Q[1]}\n{Q[2]}"),
("quote and pre", f"<body><main><h1>Mules</h1><p>{Q[0]}</p><blockquote><p>{Q[1]}</p></blockquote><pre>{Q[2]}</pre></main><div>© Hill Walks</div></body>", f"Mules\n{Q[0]}\n{Q[1]}\n{Q[2]}"),
("table", f"<body><nav><a href=1>A</a> <a href=2>B</a></nav><article><h1>Mules</h1><p>{Q[0]}</p><table><tr><th>Stage</th><th>Hours</th></tr><tr><td>Hut</td><td>3</td></tr><tr><td>Top</td><td>3</td></tr></table><p>{Q[2]}</p></article></body>", f"Mules\n{Q[0]}\nStage\nHours\nHut\n3\nTop\n3\n{Q[2]}"),
("related", f"<body><article><h1>Mules</h1>{R}</article><div class=v3><h3>Read next</h3><ul><li><a href=1>The salt road</a></li><li><a href=2>Huts of the north</a></li><li><a href=3>Ten passes</a></li></ul></div></body>", "Mules\n"+S),
("breadcrumb", f"<body><div><a href=/>Home</a> &gt; <a href=/w>Walks</a> &gt; Mules</div><article><h1>Mules</h1>{R}</article></body>", "Mules\n"+S),
("entities", "<body><article><h1>Q&amp;A</h1><p>Is 5 &lt; 6?\n  Yes,   it&nbsp;is&#33;</p><p>Fish &amp; chips cost &pound;4 at the hut, which is open from May to the end of September.</p></article></body>", "Q&A\nIs 5 < 6? Yes, it is!\nFish & chips cost £4 at the hut, which is open from May to the end of September."),
]
# fmt: on


def article_of(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
    return "\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in table(spark, "/root/testdata/sf0.1", "pages").orderBy("page_id").collect()]


@pytest.mark.parametrize("seed", [0, 1])
def test_pages_by_hand_with_any_sample(pages, seed):
    """Fitted on other pages each time: what is found may not depend on the sample."""
    sample = [pages[i] for i in np.random.default_rng(seed).permutation(len(pages))[: html_main.FIT_PAGES]]
    model = html_main.fit_layouts(html_main.laid_out(sample))
    made = PAGES + OTHERS
    wrong = [name for (name, _, want), got in zip(made, html_main.main_texts(model, [p for _, p, _ in made]), strict=True) if got != want]
    assert wrong == []
    got = html_main.main_texts(model, pages[:1000])
    assert sum(g != article_of(p) for g, p in zip(got, pages[:1000], strict=True)) <= 1


def test_hub_and_likeness():
    nodes, runs = html_main.parse("<div><p>aa</p></div><div><p>bbbb</p><p>cccc</p></div><div><div><b>x</b><p>y</p></div><div><b>x</b><p>z</p></div></div>")
    own = [0] * len(nodes)
    for k, text in runs:
        own[k] += len(text)
    hub, inside = html_main._hub(nodes, own)
    assert nodes[hub].tag == "div" and nodes[hub].place == 1 and inside == [1, 0, 0, 2, 2, 2, 0, 0, 0, 0, 0]
    alike, most = html_main._alike(nodes, own)
    assert alike[7] == alike[9] == most[6] == np.log(2) and alike[1] == alike[6] == 0
