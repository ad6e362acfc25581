from riskmart.llm import pages as P


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "t") for i, u, h in rows], "page_id long, url string, html string, host string, r int, text string")


def main(page):
    return "\n".join(t for i, d, t in P.blocks(page) if i and not d)


def test_blocks():
    assert main("<article><h1>A &amp; B</h1><p>one<br>two  <b>bold</b>x &nbsp; y<p>next &lt;p&gt;</article>") == "A & B\none two boldx y\nnext <p>"
    assert main("<main><p>a</p><script>var t='</p><p>no</p>';</script><style>p{}</style><!-- <p>no --><p>b") == "a\nb"
    assert main("<ARTICLE><nav><p>menu</p></nav><DIV CLASS='x ad-slot'>buy</DIV><p>keep</p><form><p>mail</p></form><aside>s</aside><footer>f</footer>tail") == "keep\ntail"
    assert main("<div role='main'><p title='a > b'>in</p><section class=comments><article><p>reader</p></article></section></div><p>out</p>") == "in"
    assert main("<article><p>cut &am") == "cut &am" and main("<article><p>cut <a href='x") == "cut" and main("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4</table>") == "1\n2\n3\n4"
    assert P.blocks(None) == P.blocks("") == [] and P.blocks("<p>") == []
    assert main("<article><header><h1>x</h1></header><p>shadow load heading</p></article>") == "shadow load heading"
    assert P.host("HTTPS://u@WWW.A.org:80/x") == "www.a.org" and P.host(None) == P.host("nothing") == ""


def test_unique_runs_stay(spark):
    menu = "<p>Home News Sport Weather Contact About us</p>"
    foot = "<p>All rights reserved by the owner of this site</p>"
    body = [f"<p>story number {i} tells of {i * 7} things that happened on day {i}</p>" for i in range(6)]
    rows = [(i, f"http://a.example/{i}", menu + body[i] + foot) for i in range(6)]
    rows += [(10, "http://b.example/", menu + "<p>other host</p>"), (11, "http://a.example/11", f"<article>{body[0]}{foot}</article>" + menu)]
    got = {r["page_id"]: r for r in P.op5_main_text(frame(spark, rows).repartition(4)).collect()}
    for i in range(6):
        assert got[i]["text"] == body[i][3:-4] and got[i]["n_chars"] == len(got[i]["text"]) and got[i]["n_repeated"] == 7 + 2 + 9
    assert got[10]["text"] == "Home News Sport Weather Contact About us\nother host"
    assert got[11]["text"] == body[0][3:-4] + "\n" + foot[3:-4]


def brute(rows, run):
    out = {}
    for h, r, t in rows:
        here = set()
        for s in range(len(t) - run + 1):
            if any(h2 == h and r2 != r and t[s:s + run] == t2[k:k + run] for h2, r2, t2 in rows for k in range(len(t2) - run + 1)):
                here |= set(range(s, s + run))
        if here:
            out[r] = sorted(here)
    return out


def test_repeated_runs_against_brute_force(spark):
    import random
    rnd = random.Random(7)
    base = [rnd.randrange(9) for _ in range(60)]
    rows = [(f"h{i % 2}", i, [rnd.randrange(9) for _ in range(rnd.randint(0, 30))] + base[:rnd.randint(0, 60)]) for i in range(40)]
    df = spark.createDataFrame(rows, "host string, r long, tokens array<int>")
    for run, shown in ((4, 12), (6, 24)):
        runs = P.Runs(P.run_lengths(df.repartition(3), run, shown), run, shown)
        got = {r: [i for i, x in enumerate(runs(h, t)) if x] for h, r, t in rows}
        assert {r: x for r, x in got.items() if x} == brute(rows, run)


def test_many_runs_are_joined(spark):
    rows = [(i, f"http://a.example/{i}", f"<p>one two three four five six seven</p><p>page {i} is unlike the others {i * i}</p>") for i in range(9)]
    want = sorted(map(tuple, P.op5_main_text(frame(spark, rows)).collect()))
    assert sorted(map(tuple, P.op5_main_text(frame(spark, rows), lookup=-1).collect())) == want
    assert want[2][2:] == ("page 2 is unlike the others 4", 29, 7 + 1)


def test_edges(spark):
    rows = [(None, None, None), (1, None, ""), (1, "x", "<p>"), (2, "http://h/", "<article>" + "<p>long text here</p>" * 20_000), (3, "http://h/", "<article>a</article>"), (3, "http://h/", "<article>a</article>")]
    got = sorted(((r["page_id"], r["n_chars"]) for r in P.op5_main_text(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 0), (1, 0), (1, 0), (2, 20_000 * 15 - 1), (3, 1), (3, 1)], key=str)
    assert P.op5_main_text(frame(spark, [])).count() == 0


def test_chance_phrases_and_copies_stay(spark):
    menu = "<p>Home News Sport Weather Contact About us</p>"
    phrase = "at the end of the day"
    body = [f"story {i} says that {phrase} number {i * i} wins the {i * 7} prizes" for i in range(8)]
    rows = [(i, f"http://a.example/{i}", menu + f"<p>{t}</p>") for i, t in enumerate(body)]
    rows += [(20 + i, "http://c.example/p", "<p>first paragraph of a page that two rows hold</p><p>second paragraph of the same page</p>") for i in range(9)]
    rows += [(40 + i, f"http://n.example/{i}", f"<p>an article that three addresses of the host show</p><p>read {i} times</p>") for i in range(3)]
    rows += [(60 + i, f"http://e.example/{i}", menu + f"<p>{'z ' * i}</p>") for i in range(6)]
    for lookup in (P.LOOKUP, -1):
        got = {r["page_id"]: r for r in P.op5_main_text(frame(spark, rows).repartition(3), lookup=lookup).collect()}
        assert len(got) == len(rows) and [got[i]["text"] for i in range(8)] == body and all(got[i]["n_repeated"] >= 7 + 6 for i in range(8))
        for i in range(9):
            assert got[20 + i]["text"] == "first paragraph of a page that two rows hold\nsecond paragraph of the same page" and got[20 + i]["n_repeated"] == 0
        for i in range(3):
            assert got[40 + i]["text"] == f"an article that three addresses of the host show\nread {i} times"
        assert got[60]["text"] == menu[3:-4] and got[63]["text"] == "z z z"


def test_containers_below_forms_and_layout(spark):
    article = "<article><p>the story</p></article>"
    nav = "<nav><p>menu of the site</p></nav>"
    for start, end in (("<form id='aspnetForm'>", "</form>"), ("<div class='layout has-sidebar'>", "</div>"), ("<section class='page with-banner'>", "</section>"),
                       ("<div id='main-menu-page'>", "</div>"), ("<main><form>", "</form></main>"), ("<div class='wide-sidebar'>", "</div>")):
        got = P.op5_main_text(frame(spark, [(1, "http://h/", f"<body>{start}{nav}{article}{end}</body>")])).first()
        assert got["text"] == "the story", start
    teaser = "<article><p>a teaser</p></article>"
    for start, end in (("<div class=comments>", "</div>"), ("<ul class='related-posts'>", "</ul>"), ("<div class='x ad-slot'>", "</div>"), ("<aside>", "</aside>"),
                       ("<div class=sidebar>", "</div>"), ("<div hidden>", "</div>")):
        assert main(f"<div class='page has-sidebar'>{article}{start}{teaser}{end}</div>") == "the story", start
    rows = [(1, "http://h/1", f"<form>{nav}<p>text without any container</p></form>"), (2, "http://h/2", f"<main><form><p>text of a form</p></form></main>{nav}"),
            (3, "http://h/3", nav), (4, "http://h/4", f"<div class=sidebar>{teaser}</div><p>plain text</p>")]
    got = {r["page_id"]: r["text"] for r in P.op5_main_text(frame(spark, rows)).collect()}
    assert got == {1: "text without any container", 2: "text of a form", 3: "", 4: "plain text"}


def test_class_words_do_not_drop_paragraphs_or_the_only_container():
    from riskmart.llm.pages import _page

    def main(page):
        return _page("http://h/x", page)[1]
    foot = "<footer>Foot</footer>"
    assert main("<article><h2 class='related'>Head</h2><p class='social-history'>Social history para</p><ul><li id='menu-1'>One</li></ul>"
                "<div class='share'>Share it</div></article>" + foot) == "Head\nSocial history para\nOne"
    assert main("<div class='related-story'><article><p>Story</p></article></div>" + foot) == "Story"
    assert main("<div class='related-story'><article><p>Story</p></article></div><p>Plain</p>" + foot) is None
    assert main("<aside><main><p>Story</p></main></aside>") == "Story"
    assert main("<article><p>Story</p></article><div class='related-story'><article><p>Other</p></article></div>") == "Story"
    assert main("<article><p>Story</p><aside><p class='x'>Beside</p></aside></article>") == "Story"
    assert main("<div class='comments'><article><p>Reader</p></article></div><p>Body text</p>") is None
    assert main("<aside><article>A</article><article>B</article></aside><div>Body text</div>") is None
