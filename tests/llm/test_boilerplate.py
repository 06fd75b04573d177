import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lexmill.llm import boilerplate as B
from lexmill.llm import mojibake as M
from lexmill.llm.boilerplate_queries import fetched

ARTICLE = "The mill was measured again in spring, and its keepers wrote a long report about it. Nobody expected the figures to stand, yet they did, for the third year in a row. Visitors may read it."
NAMES = ["Ann", "Bo", "Cy", "Dee", "Eve", "Flo", "Gus", "Hal", "Ida", "Jon"]
TOPICS = ["mill", "river", "kiln", "orchard", "harbour", "bridge", "archive", "tower", "ferry", "weir"]


def page(i):
    name, topic = NAMES[i % 10], TOPICS[i // 3 % 10]
    body = ARTICLE.replace("mill", topic).replace("spring", f"year {i}")
    box = f"Trending now\nWhat the {TOPICS[i % 7]} taught {NAMES[i % 7]} this year\nWhy {name} left the {topic} alone"
    cookie = "Some cookies are needed here. By staying you accept our terms."
    return "\n".join(
        [
            "Home", "News", "Shop", *([cookie, "Reject all"] if i % 2 else []), *(box.split("\n") if i % 3 == 0 else []),
            f"How the {topic} of {name} works", f"By {name}, 2024-01-0{i % 9 + 1}", f"{body} Part {i}.",
            *(["Advertisement"] if i % 4 == 0 else []), f"{name} and the wheels of the {topic}", f"- Wheel {i} of {name} was kept", body,
            *(box.split("\n") if i % 3 == 1 else []), *([cookie, "Reject all"] if i % 2 == 0 else []), *(["Advertisement"] if i % 4 else []), "Share this page", "Back to top", "© 2024 site.example. All rights reserved.",
        ]
    )


PAGES = [(f"How the {TOPICS[i // 3 % 10]} of {NAMES[i % 10]} works", page(i)) for i in range(300)]


def ratios(pages):
    return B.Ratios.of(B.path_sums(B.Pages([p[0] for p in pages], [p[1] for p in pages])))


STATS = ratios(PAGES)


def body(title, text, stats=STATS, url="https://site.example/a"):
    (main,) = B.judge([url], [title], [text], stats)
    return [x for x, m in zip(text.split("\n"), main, strict=True) if m] if text else main


def test_main_body_without_word_lists():
    for i in range(20):
        title, text = PAGES[i]
        kept = body(title, text)
        assert kept[0] == title and kept[1].startswith("By ") and sum(len(x) > 140 for x in kept) == 2
        assert not {"Trending now", *(["Advertisement"] if i % 4 else []), "Share this page", "Back to top", "Advertisement", "Reject all", "Home"} & set(kept)
        assert not any("cookies" in x or x.startswith(("What the", "Why ")) for x in kept)


def test_the_ratios_decide():
    title, text = PAGES[0]
    with_ratios, without = body(title, text), body(title, text, B.Ratios.empty())
    assert "Share this page" not in with_ratios and "Share this page" in without
    assert sum(len(x) > 140 for x in with_ratios) == 2 and not any(len(x) > 140 for x in without)


def test_long_notices_go_by_their_ratios():
    notice = "Our partners keep data on your device. With your consent we measure visits. You may object at any time by writing to the office of this page, and we will answer"
    odd = [(t, x.replace("Share this page", f"{notice}\nShare this page")) for t, x in PAGES]
    assert B.layouts(pa.array([notice]))[0][0] == B.PARAGRAPH
    s = ratios(odd)
    raw, _ = B.fused_scores(B.Pages([None, None], [notice, ARTICLE]), s)
    assert raw[0] < raw[1]


def test_crumb_names_the_headline():
    text = "Home / Mills / How the mill 3 wo\nHow the mill 3 works\n" + ARTICLE
    assert B.headline_at(text.split("\n"), None) == 1


def test_edges():
    assert B.judge([None] * 3, [None] * 3, [None, "", "\n "], STATS) == [[], [], [True, True]]
    gone = "Home\nShop\nReject all"
    assert B.judge(["https://x.example"], ["Gone"], [gone], STATS) == [[False] * 3]
    assert B.judge([None], [None], [ARTICLE * 2000], STATS) == [[True]]
    assert B.judge([], [], [], STATS) == []
    assert not B.path_sums(B.Pages([None], [None])).any()


def test_layouts():
    kinds = {
        "Home | Shop | News | About": B.MENU, "a | 12 | 4.5": B.TABLE, "$ run --fast file": B.COMMANDS, "- Point one": B.BULLETED,
        "Short title": B.LABEL, "This is one sentence.": B.SENTENCE, ARTICLE: B.PARAGRAPH, " ": B.BLANK, "- " + ARTICLE: B.POINTS,
    }
    assert dict(zip(kinds, B.layouts(pa.array(list(kinds)))[0].tolist(), strict=True)) == kinds


def test_sums_agree_with_a_plain_count():
    pages = B.Pages([p[0] for p in PAGES], [p[1] for p in PAGES])
    sums = B.path_sums(pages)
    lines = [x for _, text in PAGES for x in text.split("\n")]
    assert sums[0, -1] == len(lines) and sums[1, -1] == sum(map(len, lines)) and sums[2, -1] == sum(x.count(c) for x in lines for c in ".,:;")
    leaf = B.paths(pa.array(["trending NOW!"]), np.array([B.LABEL]), np.array([False])).leaf[0]
    assert sums[0, leaf] >= sum(x == "Trending now" for x in lines) and sums[5, leaf] == sums[6, leaf] == 100
    halves = [B.path_sums(B.Pages([p[0] for p in part], [p[1] for p in part])) for part in (PAGES[:100], PAGES[100:])]
    assert (halves[0] + halves[1] == sums).all()


def test_boxes_have_no_fixed_length():
    title, text = PAGES[1]
    long_box = "Trending now\n" + "\n".join(f"- What the {t} taught {n} this year" for t, n in zip(TOPICS, NAMES, strict=True))
    kept = body(title, text.replace("Share this page", long_box + "\nShare this page"))
    assert not any(x.startswith("- What") for x in kept)


def test_spark_agrees_with_one_process(spark, sf):
    pages = fetched(spark, sf)
    rows = pages.collect()
    one = B.Ratios.of(B.path_sums(B.Pages([r.title for r in rows], [r.text for r in rows])))
    many = B.corpus_ratios(pages.repartition(5))
    assert all((getattr(one, c) == getattr(many, c)).all() for c in ("tpr", "ptpr", "odds", "n", "leads"))


def test_empty_tables(spark, sf):
    pages = fetched(spark, sf).limit(0)
    assert not B.corpus_ratios(pages).n.any()
    assert B.judge_pages(pages, B.Ratios.empty()).count() == 0


def test_the_result_hangs_on_the_ratios(sf):
    """With the statistics emptied the result collapses."""
    t = pq.read_table(f"{sf}/fetched_pages.parquet", columns=["url", "title", "text"]).to_pydict()
    cols = t["url"], t["title"], t["text"]
    stats = B.Ratios.of(B.path_sums(B.Pages(*cols[1:])))
    full, bare = ({(p, i) for p, page in enumerate(B.judge(*cols, s)) for i, m in enumerate(page) if not m} for s in (stats, B.Ratios.empty()))
    assert len(full & bare) < 0.85 * len(full | bare)


def test_a_page_with_one_garbled_line_is_judged_by_it_restored(spark):
    plain = "“Leave the ledger – all of it – alone,” said Ann. • It’s late. • Até já, suscríbase ahora."
    model = M.fit([plain] * 60)
    texts = [f"Home\nHow the mill works\n{ARTICLE}\n{line}\n{ARTICLE}" for line in ("Suscríbase hoy", "SuscrÃ\xadbase hoy")]
    stats = ratios([*PAGES, *[("How the mill works", texts[0])] * 20])
    rows = [(str(i), i, "https://site.example/a", "How the mill works", text, None) for i, text in enumerate(texts)]
    pages = spark.createDataFrame(rows, "origin string, rec_id bigint, url string, title string, text string, version timestamp_ntz")
    outside = {r.rec_id: r.outside for r in B.judge_pages(pages, stats, model).collect()}
    assert outside[1] == outside[0]


def test_words_of_the_dictionaries_are_counted_over_all_pages(spark):
    pages = spark.createDataFrame([(f"Page {i}", f"The ferry ledger number {i}.\nTwo Wolkenbruchsammler stood there." if i % 500 == 0 else f"The ferry ledger number {i}.") for i in range(2000)], "title string, text string")
    ratios, pairs, words = B.corpus_statistics(pages.repartition(5))
    assert {"ledger": 2000, "Wolkenbruchsammler": 4}.items() <= dict(words["en"]).items()
    assert (pairs, words) == B.corpus_statistics(pages.coalesce(1))[1:] and pairs == M.corpus_pairs(pages)
