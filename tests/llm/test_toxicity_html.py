import pytest
import random

from parlance.llm import html_text, toxicity
from tests.llm.cases import frame, texts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_equals_distance():
    r, terms = random.Random(2), ["loser", "idiot", "pathetic", "worthless", "losers"]
    trie = toxicity.Trie(terms)
    for _ in range(3000):
        w = list(r.choice(terms))
        for _ in range(r.randrange(3)):
            k = r.randrange(len(w))
            w[k:k + r.randrange(2)] = r.choice(["", "a", "e", "st"])
        w = "".join(w)
        got = {k for k in trie.within_one(w) if terms[k] != w} if w else set()
        assert got == {k for k, t in enumerate(terms) if w and distance(w, t) == 1}


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    r = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    good = r.where("predicted = toxic").count() / r.count()
    assert good > 0.97 and r.where("predicted = 1 AND toxic = 0").count() <= 3


def test_copies_need_both_minima_and_one_label(spark):
    # texts that share a passage, so that some agree in one minimum only
    shared = " ".join(f"s{i}" for i in range(40))
    rows = [(i, f"{shared} " + " ".join(f"d{i}_{j}" for j in range(20)), 0) for i in range(60)] + [(100, shared, 0), (101, shared, 1), (102, shared, 0)]
    schema = "doc_id long, text string, toxic int"
    sample = spark.createDataFrame(rows, schema)
    keys = sample.mapInArrow(toxicity._keys, schema + ", k0 long, k1 long").collect()
    want = len({(r.toxic, r.k0, r.k1) for r in keys})
    assert want > len({r.k0 for r in keys})
    got = [sorted(map(tuple, toxicity.one_of_copies(spark.createDataFrame(r, schema).repartition(n)).collect())) for r, n in ((rows, 1), (rows[::-1], 7))]
    assert len(got[0]) == want and got[0] == got[1] and {t for _, t in got[0]} == {0, 1}


def test_quotation_and_odd_rows(spark):
    model = toxicity.Model({"idiot": 8.0}, [3.0, 1.0, 0.0, 0.0], -4.0)
    s = toxicity.Scorer(model)
    assert s.score("you idiot") > 0.7 > s.score('he wrote "you idiot" to them')
    assert s.score("you idioot") > s.score("you are fine")
    docs = frame(spark)
    scored = toxicity.score_documents(docs.drop("score"), model)
    assert scored.count() == docs.count() and scored.where("score IS NULL OR predicted IS NULL").count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    assert toxicity.toxicity(docs, none).select("score").distinct().count() == 1
    kept = toxicity.drop_toxic(docs, none)
    assert kept.columns == docs.columns and kept.count() == len(texts())
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


PAGE = """<html><head><title>x</title><style>p{}</style></head><body><nav><a href=1>Home</a></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Title &amp; more</h1></header><p>One  two<br>three &eacute;<p>Second <b>bold</b> para<ul><li>a<li>b</ul><form>Search</form></article>
<div id="comments"><p>A reader says a lot of things here, much longer than the article itself, again and again and again.</p></div><footer>f</footer></body></html>"""


def test_pages(spark):
    assert html_text.main_text(PAGE) == "Title & more\nOne two three é\nSecond bold para\na\nb"
    plain = PAGE.replace("<article>", '<div class="content">').replace("</article>", "</div>").replace("<header>", "").replace("</header>", "")
    assert html_text.main_text(plain) == "Title & more\nOne two three é\nSecond bold para\na\nb"
    for odd in ("", "<", "<p", "<!-- c", "<div>" * 5000 + "deep", "<script>x", "</p></p>", "&#0;&#x110000;"):
        assert isinstance(html_text.main_text(odd), str)
    rows = spark.createDataFrame([(1, "u", PAGE, "k"), (1, "u", PAGE, "k"), (2, None, None, "k"), (None, "v", "", "k")], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(rows)
    assert got.count() == 4 and got.where("n_chars <> length(text)").count() == 0
    assert html_text.extract_pages(rows.limit(0)).count() == 0


def test_title_and_lead_beside_a_nested_text_div():
    inner = "".join(f"<p>{'word ' * 75}</p>" for _ in range(20))
    menu = "<ul>" + "".join(f"<li><a href={i}>Menu {i}</a></li>" for i in range(12)) + "</ul>"
    page = f"<body>{menu}<div class=post><h1>{'t' * 30}</h1>bare words <a href=1>here</a> too<p>{'lead ' * 75}</p><div class=text>{inner}</div></div></body>"
    for p in (page, page.replace(menu, "")):
        lines = html_text.main_text(p).split("\n")
        assert lines[:3] == ["t" * 30, "bare words here too", ("lead " * 75).strip()] and lines[3:] == [("word " * 75).strip()] * 20


BODY = "".join(f"<p>Paragraph {i} of the article, long enough to count as running text of its own.</p>" for i in range(6))
TEXT = [f"Paragraph {i} of the article, long enough to count as running text of its own." for i in range(6)]
MENU = "<ul class='menu'>" + "".join(f"<li><a href='/{i}'>Entry {i}</a></li>" for i in range(8)) + "</ul>"


@pytest.mark.parametrize("page,want", [
    (f"<article><header class='entry-header'><h1>Title</h1></header>{BODY}</article>", ["Title", *TEXT]),
    (f"<article><div class='article-header'><h1>Title</h1><p>Lead text.</p></div>{BODY}</article>", ["Title", "Lead text.", *TEXT]),
    (f"<div class='search-results-page'>{BODY}</div>", TEXT),
    (f"<div class='widget' id='main-search'>{BODY}</div>", TEXT),
    (f"<main><div class='teaser'><p>Read also this.</p></div><article><h1>Title</h1>{BODY}</article><article><h2>Other</h2><p>Short teaser of another article.</p></article></main>", ["Title", *TEXT]),
    (f"<main><h1>Title</h1>{BODY}<div class='share-buttons'>Share it</div></main>", ["Title", *TEXT]),
])
def test_titles_leads_and_teasers(page, want):
    whole = f"<html><body><div class='site-header'>The site</div>{MENU}{page}<div class='cookie-notice'>We use cookies.</div><div class='site-footer'>Imprint</div></body></html>"
    assert html_text.main_text(whole).split("\n") == want
