"""HTML text and embedding near-duplicates."""

import math
import re

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from auditspark.llm import embedding_dedup as E
from auditspark.llm import html_text as H

PAGE = """<html><head><title>t</title><style>p{}</style><script>var a = "</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use the cookies that you like.</div>
<article><header><h1>A title</h1></header><p>First &amp; best&nbsp;words<br>of <b>the
 text</b>.<p>Short.</p><aside>Look at this and that.</aside>
<div class="related"><p>Other things that you may like</p></div><ul><li>one</li><li>two</li></ul>
<form><label>Name of the user</label><input></form></article>
<section id="comments"><p>I do not agree with this at all, and that is what I think of it.</p></section>
<div class="ad">Buy it</div><footer>&copy; 2024</footer>"""


def test_article_only():
    assert H.main_text(PAGE) == "A title\n\nFirst & best words of the text.\n\nShort.\n\none\n\ntwo"


def test_marked_blocks():
    page = '<article class="post has-sidebar"><p class="sponsored-link">Buy</p><p style="overflow: hidden">Kept here.</p><p hidden>Not seen</p><button>Press</button><h2 class="entry-header">Head</h2></article><article class="comment"><p>I say no.</p></article>'
    assert H.main_text(page) == "Kept here.\n\nHead"


def test_pages_without_article():
    good = "This is a text that is long enough to be read by the people who like to read, and it has many of the words that they use. " * 2
    page = f"<body><div class='menu'><a>x</a></div><h1>Head</h1><p>{good}</p><p>Short one.</p><p>{good}</p><p><a href=x>all of it is a link</a></p></body>"
    assert H.main_text(page).split("\n\n") == ["Head", " ".join(good.split()), "Short one.", " ".join(good.split())]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!-- ", "<script>", "a < b > c", "<div " * 500, "</article></p>", '<a href="x>'])
def test_odd_pages(page):
    H.main_text(page)


RUSSIAN = "Старый мост через реку построили ещё в прошлом веке, и с тех пор по нему ходят пешком все жители города. Весной его закрывают на ремонт, а летом там сидят рыбаки и смотрят на воду. Никто уже не помнит имени мастера. "
CHINESE = "这座古老的桥建于上个世纪，从那时起城里的居民每天都步行经过这里。春天桥会关闭维修，夏天渔夫们坐在桥上看着河水。没有人记得那位工匠的名字，但每个人都喜欢他的作品。孩子们在桥下玩耍，老人们在桥头下棋，日子一天天过去。"
POLISH = "Stary most nad rzeką zbudowano jeszcze w ubiegłym wieku, odtąd chodzą tamtędy pieszo wszyscy mieszkańcy miasta. Wiosną bywa zamykany, latem siedzą tam rybacy, patrzą spokojnie. Nikt już nie pamięta imienia mistrza. "
ENGLISH = "The old bridge over the river was built in the last century, and since then all the people of the town have walked over it. In spring it is closed, and in summer there are anglers who look at the water. No one knows the name of its builder. "


@pytest.mark.parametrize("text", [RUSSIAN * 2, CHINESE, POLISH * 2, ENGLISH * 2])
@pytest.mark.parametrize("frame", [
    "<body><div class=menu><ul><li><a href=/>{m}</a></li></ul></div><div>{t}</div><div>{t}</div><div class='footer'>{m}</div>",
    "<body><nav>{m}</nav><main><h1>{m}</h1><p>{t}</p><p>{t}</p></main><aside>{t}</aside><footer>{m}</footer>",
    "<body><table><tr><td><a href=/1>{m}</a><a href=/2>{m}</a></td><td><p>{t}</p><p>{t}</p></td></tr></table>",
    "<body><div id=sidebar><p>{t}</p></div><div id=content><p>{t}</p><button>{m}</button><p>{t}</p></div><form>{t}</form><script>var a = '{t}';</script>",
    "<body><p>{t}<p>{t}<div class=comments><p>{t}</div><p class='cookie-notice'>{t}</p>",
])
def test_templates_and_scripts(text, frame):
    body = " ".join(text.split())
    page = frame.format(t=text, m="Menü 12")
    parts = H.main_text(page).split("\n\n")
    assert [p for p in parts if p != "Menü 12"] == [body, body]
    assert len(parts) == (3 if "<h1>" in frame else 2)


@pytest.mark.parametrize("part", ["<a ", '<a "', "<a '\"", "<!", "<div", "</", "<a b='", "<p><a ", "&", "<script", "<!--", '<a x="<b y=\'<c ', "<button>", "<div>", "</div>", "<div></p>"])
def test_long_odd_pages(part):
    import time

    began = time.process_time()
    H.main_text("<p>before</p>" + part * (1_000_000 // len(part)))
    assert time.process_time() - began < 10


def test_nested_containers():
    import time

    began = time.process_time()
    assert H.main_text("<article>" + "<div>" * 100_000 + "<p>Deep words.</p>" + "</div>" * 100_000 + "</article>") == "Deep words."
    H.main_text("<section>" + "<div></ul>" * 100_000 + "</section>" * 100_000)
    assert time.process_time() - began < 5


def test_raw_elements_in_any_case():
    page = "<article><p>The İstanbul text.</p><{0}>var x = '<p>no</p>';</{1}><p>More of the text.</p></article>"
    for a, b in (("script", "SCRIPT"), ("Style", "sTYLE"), ("TEXTAREA", "textarea")):
        assert H.main_text(page.format(a, b)) == "The İstanbul text.\n\nMore of the text."
    assert H.main_text(page.format("script", "\u017fcript")) == "The İstanbul text."


def test_linked_paragraph_of_an_article():
    good = "This is a text that is long enough to be read by the people who like to read, and it has many of the words that they use. "
    page = f"<article><h1>Head</h1><p>{good}</p><h2>See also</h2><p><a href=x>The other page that says more about all of this</a></p><p>{good}</p></article><p><a href=y>Outside link</a></p>"
    assert H.main_text(page).split("\n\n") == ["Head", good.strip(), "See also", "The other page that says more about all of this", good.strip()]


def test_pages_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in H.extract_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(H.html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"<(?:p|/p|h1|/h1)>", article)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None, 5), (None, "u", "<article>x</article>", 5), (1, None, None, 5)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id is None, r.text) for r in H.extract_text(odd).collect()) == [(False, ""), (False, ""), (True, "x")]
    assert H.extract_text(pages.limit(0)).count() == 0


def vectors(seed=0, n=160, d=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 8, d))
    rows = [(base[i % len(base)] + rng.normal(size=d) * rng.choice([0, 0.05, 0.15, 0.25])).astype(np.float32) for i in range(n)]
    return [(i, [float(x) for x in v], int(i % len(base)) % 3) for i, v in enumerate(rows)]


ODD = [(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [float("nan")] + [1.0] * 23, 1), (904, [None] + [1.0] * 23, 1), (905, [float("inf")] + [1.0] * 23, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (908, [1.0, 2.0], None), (906, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (None, [5.0, -3.0], 2)]
#: Rows that share an id but not a vector: the id joins nothing.
ODD += [(950, [1.0, 0.0, 0.0], 1), (952, [1.0, 0.001, 0.0], 1), (950, [0.0, 1.0, 0.0], 1), (940, [0.001, 1.0, 0.0], 1)]


#: Lengths whose squares vanish or overflow.
ODD += [(960, [1e-200, 2e-200, 0.0, 0.0], 1), (961, [1e200, 2e200, 0.0, 0.0], 1), (962, [1e-310, 2e-310, 0.0, 0.0], 1), (963, [1.7e308, -1.7e308, 1.7e308, 0.0], 1), (964, [5e-324, 0.0, 0.0, 0.0], 1), (965, [1.0, 2.0, 0.001, 0.0], 1)]


@pytest.mark.parametrize("tile, group, dim", [(16, 2, 24), (4, 3, 24), (1024, 16, 24), (16, 2, 1500)])
def test_links_equal_brute_force(spark, monkeypatch, tile, group, dim):
    monkeypatch.setattr(E, "TILE", tile)
    monkeypatch.setattr(E, "GROUP", group)
    rows = vectors(d=dim) + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    for clash in ("grp", "k1", "copies", "node", "part", "component_id", "n_links"):
        df = df.withColumn(clash, F.lit("clash"))
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            if i != j and fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[n][1]) / max(map(abs, rows[n][1])) for n in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98 or rows[i][1] == rows[j][1]:
                    links[i].append(j)
    expected = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in links[todo.pop()] if j not in seen and not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        expected.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.embedding_components(df).collect()]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert sum(len(x) for x in links) > (100 if dim < 100 else 10)


def test_bound_holds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = E.quantise(x)
    near = E.product(q, q) * (s[:, None] * s[None])
    assert (np.abs(x @ x.T - near) <= (1 + e)[:, None] * e[None] + e[:, None] + 1e-9).all()


def test_empty_vectors(spark):
    assert E.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
