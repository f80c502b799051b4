"""Each operator against brute force on a small table, and on odd rows and empty tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lernwerk.llm import bpe, html_text, lines, minhash, mixing, passages, pii, quality, topk, toxicity
from lernwerk.llm.common import Shared, components

from .conftest import SF, prose, rows

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").encode().lower().split()


# ---- components


@pytest.mark.parametrize("edges", [[(1, 2), (3, 4), (2, 3), (9, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], []])
def test_components(spark, edges):
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame([(max(e), min(e)) for e in edges], "a long, b long").repartition(5), Shared(spark))
    assert rows(got, "node", "root") == sorted((x, root(x)) for x in parent)


# ---- 1 toxicity


def test_toxicity_finds_unseen_forms_whatever_the_length(spark, table):
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(i, 60)
        if bad:
            at = text.split()
            at.insert(i % 50, "grumbla" + "abcdefgh"[i // 4 % 8] * 2)
            text = " ".join(at)
        docs.append((i, text))
        labels.append((i, int(bad)))
    new = [(1000, prose(1000, 40) + " grumblazz " + prose(1001, 3000)), (1001, prose(1002, 3000)), (1002, "grumblaxy")]
    df = table(*docs, *new)
    got = {r.doc_id: r for r in toxicity.scores(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[i].predicted for i in (1000, 1001, 1002)] == [1, 0, 1]
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in held) for i in range(400))
    assert sum(got[i].predicted == (i % 4 == 0) for i in held) >= 0.97 * len(held)


def test_toxicity_learns_from_long_texts_where_no_others_are_toxic(spark, table):
    insult = "you filthy worthless vermin should vanish"
    docs = [(i, " ".join([prose(i, 450), *([insult] * 3 + [prose(i + 900, 150)]) * 3 * (i % 4 == 0), prose(i + 500, 450)])) for i in range(200)]
    docs = [(i, t if i % 4 else t + " " + prose(i, 300)) for i, t in docs]
    assert all(len(t) > toxicity.TRAIN_CHARS for i, t in docs if i % 4 == 0)
    df = table(*docs)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in docs], "doc_id long, toxic int")
    kept = toxicity.sample(df, labels).collect()
    assert {r.toxic for r in kept} == {0, 1} and all(len(r.text) <= toxicity.LONG_PIECES * (toxicity.TRAIN_CHARS + 1) for r in kept)
    got = toxicity.scores(df, labels).where("held_out").collect()
    assert all((r.doc_id % 4 == 0) == bool(r.predicted) for r in got) and any(r.predicted for r in got)


def test_toxicity_takes_short_texts_first(spark, table, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 10)
    monkeypatch.setattr(toxicity, "TRAIN_CHARS", 40)
    df = table(*[(i, prose(i, 4 if i % 2 else 60)) for i in range(200)])
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(200)], "doc_id long, toxic int")
    kept = toxicity.sample(df, labels).collect()
    assert sum(r.toxic for r in kept) == 10 and all(len(r.text) <= 40 for r in kept if r.toxic)
    few = toxicity.sample(df.where("doc_id % 2 = 0 or doc_id < 10"), labels).where("toxic = 1").collect()
    # the short ones, then stretches of long ones until the characters of ten short ones are reached
    assert 1 < len(few) < 10 and sum(len(r.text) for r in few[:-1]) < 400 and max(len(r.text) for r in few) > 40


def test_toxicity_odd_rows(spark, odd, table):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scores(odd, none).collect()} == {0.0}
    some = spark.createDataFrame([(4, 1), (7, 0), (10, 0), (10, None), (12, 1)], "doc_id long, toxic int")
    got = toxicity.scores(odd, some)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").isEmpty()
    assert rows(got.where("doc_id in (1, 2, 3)"), "score") == [(0.0,)] * 3
    assert toxicity.scores(table(), none).isEmpty()


# ---- 2 near-duplicates


def brute_groups(docs, k=5, percent=75):
    sets = {i: frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if (w := words(t)) else frozenset() for i, t in docs}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def test_near_duplicates_are_the_exact_groups(table):
    docs = [(i, prose(i, 30 + i)) for i in range(20)]
    base = prose(77, 90).split()
    for i in range(60):  # variants of one text, each with words of its own in other places
        w = list(base)
        for j in range(1 + i % 4):
            w[(i * 7 + j * 23) % 90] = f"own{i}x{j}"
        docs.append((100 + i, " ".join(w)))
    chain = prose(55, 120).split()
    docs += [(200 + i, " ".join(chain[i * 6:i * 6 + 80])) for i in range(6)]
    docs += [(300, "Two Words"), (301, "two  words"), (302, "two"), (303, prose(3, 33).upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(table(*docs)).collect()}
    assert got == brute_groups(docs)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    for n, shared in ((300, 200), (20, 12), (4000, 3000)):
        items = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
        a, b = minhash.super_minhash(items[:n], 512), minhash.super_minhash(items[n - shared:], 512)
        assert abs(np.mean(a == b) - shared / (2 * n - shared)) < 0.09


def test_near_duplicates_odd_rows(spark, odd, table):
    got = minhash.near_duplicates(odd)
    assert got.count() == odd.count()
    assert rows(got.where("doc_id in (1, 2, 3, 11)"), "n_shingles", "component_id", "kept") == [(0, 1, True), (0, 2, True), (0, 3, True), (0, 11, True)]
    assert rows(got.where("doc_id = 9"), "component_id", "kept") == [(9, True)] * 2
    assert rows(got.where("doc_id is null"), "component_id", "kept") == [(None, False)]
    assert minhash.near_duplicates(table()).isEmpty()
    assert minhash.stage(spark, odd, SF).columns == odd.columns


# ---- 3 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


TRICKY = [
    "a@b.c_d@e.f x@y z@w.com. q@r..s u@v-w.de,🙂 é@x.yz me@example.com.", "1.2.3.4.5.6.7.8 300.1.1.1 0001.2.3.255 1.2.3 999999999999999.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5 4111  1111 1111 1111",
    "+49 (30) 1234567 +1 2 +1 (208) 555-3235+44 20 7946 0958 +123456789012345678", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9", "9" * 5000, "a." * 3000, "1." * 3000, "12-" * 2000, "🙂🙂 a@b.cd 🙂 1.1.1.1",
]


def test_base_spans_are_those_of_the_patterns(spark, table):
    import pandas as pd

    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    texts = TRICKY + list(known["text"])
    docs = table(*enumerate(texts))
    docs.write.mode("overwrite").parquet(f"{Shared(spark).root}/documents.parquet")
    shared = Shared(spark)
    docs.write.parquet(f"{shared.root}/documents.parquet")
    got = pii.op3_pii(spark, shared.root).toPandas().set_index("doc_id")
    for i, text in enumerate(texts):
        want = base_spans(text)
        assert got.loc[i, "base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (text[:80], want[:200], got.loc[i, "spans"][:200])
        assert set(filter(None, want.split(","))) <= set(got.loc[i, "spans"].split(","))
    assert isinstance(got, pd.DataFrame)


def test_personal_data_added_by_the_trees(spark, table):
    texts = [f"{prose(i, 6)} call +1 (20{i % 10}) 555-{1000 + i} {prose(i, 5)} id {100000 + 37 * i} {prose(i, 3)} mail a{i}@ex.org v{i}.1.2.3 {7 * i}.{i % 256}.3.4 4111 1111 1111 {1000 + i} 41111111{10000000 + i}" for i in range(150)]
    texts += ["please call (208) 555-3235 soon", "server 10[.]0[.]0[.]7 is up"]
    _, spans = pii.found_spans(table(*enumerate(texts)), Shared(spark))
    added = spans.where("not base").collect()
    assert all(s.score >= 0.5 for s in added)
    base = spans.where("base").groupBy("uid").count().count()
    assert base >= 150


def test_overlapping_added_spans_are_taken_best_first(spark):
    spans = [
        (1, "card", 0, 10, False, 0.9), (1, "phone", 8, 20, False, 0.8), (1, "ip", 18, 30, False, 0.7),  # a chain: the ends stay
        (2, "card", 0, 10, False, 0.7), (2, "phone", 8, 20, False, 0.9), (2, "ip", 18, 30, False, 0.8),  # the middle stays
        (3, "email", 5, 9, True, 0.1), (3, "card", 0, 6, False, 0.9), (3, "card", 8, 12, False, 0.9), (3, "card", 9, 12, False, 0.6),
        (4, "card", 0, 30, False, 0.5), (4, "ip", 2, 4, False, 0.9), (4, "ip", 10, 14, False, 0.4), (4, "ip", 12, 40, False, 0.6),
    ]
    df = spark.createDataFrame(spans, "uid long, kind string, start long, end long, base boolean, score double")
    assert rows(pii.resolved(df), "uid", "start", "end") == [(1, 0, 10), (1, 18, 30), (2, 8, 20), (3, 5, 9), (3, 9, 12), (4, 2, 4), (4, 12, 40)]


def test_personal_data_odd_rows(spark, odd, table):
    ids, spans = pii.found_spans(odd, Shared(spark))
    assert ids.count() == odd.count()
    assert [(r.kind, r.start) for r in spans.collect()] == [("phone", 6)]
    assert pii.found_spans(table(), Shared(spark))[1].isEmpty()


# ---- 4 pages

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class=top><h1>Site</h1><nav><a href="x">Home</a></nav></header><div class="cookie-notice">We use cookies</div>
<main><div class="post-12 content"><h1>T &amp; x</h1><p>Para one with <a href=q>link</a> &lt;b&gt; here.<p>Two<br>lines &nbsp; x
<!-- no --><ul><li>a<li>b</ul></div><section id="comments"><p>nice post, a very long comment text stands here to be left out</section></main>
<aside>side</aside><form><input><label>mail</label></form><footer>foot"""


def test_page_text():
    assert html_text.Page(PAGE).text([]) == "T & x\nPara one with link <b> here.\nTwo lines x\na\nb"


def test_host_paths_outvote_a_page_of_its_own(spark):
    def page(i, text, ad):
        return i, f"http://h{i % 2}.example/{i}", f"<body><div class='box'><p>{ad}</p></div><div class='text{i}'><p>{text}</p></div>"

    pages = [page(i, prose(i, 60), "buy this") for i in range(9)] + [page(9, "short text", prose(5, 80))]
    df = spark.createDataFrame([*pages, (20, None, None), (21, "x", ""), (22, "http://h0.example/1", "<p>" * 3000 + "deep"), (23, "u", "a < b <c d='>'>e <f g=\"h"), (24, "", "<" * 3000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.main_text(df.withColumns({"host": F.lit(1), "paths": F.lit(2), "text": F.lit(3)})).collect()}
    assert got[9].text == "short text" and all(got[i].text == prose(i, 60) for i in range(9))
    assert (got[20].text, got[21].text, got[22].text) == ("", "", "deep")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.main_text(df.limit(0)).isEmpty()


@pytest.mark.parametrize("around", ["layout no-sidebar", "page has-comments", "post share-enabled"])
def test_an_article_stays_below_ambiguous_classes(around):
    text = "words of the article stand here"
    comments = "<div class='comment-list'><article class='comment-body'><p>a reader's long remark about it all</article></div>"
    assert html_text.Page(f"<body><nav>menu</nav><div class='{around}'><article><p>{text}</p></article></div>{comments}").text([]) == text
    assert html_text.Page(f"<body><nav>menu</nav><div class='{around}'><p>{text * 4}</p></div><div class='cookie-notice'>we use them</div>").text([]) == text * 4
    assert html_text.Page(f"<body><form action=x><main><p>{text}</main><input></form>").text([]) == text
    assert html_text.Page(f"<body><div class=post><p>{text}</div><form><p>{text * 4}</form>").text([]) == text


def test_page_text_keeps_formulas():
    assert html_text.Page("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</article>").text([]) == "so x=2 holds"


def test_generated_pages():
    """Articles of nested blocks between notices, in any order: the text is known from the making."""
    rng = np.random.default_rng(8)
    noise = [f"<{t}>menu or note {i}</{t}>" for i, t in enumerate(("nav", "aside", "footer", "form", "script"))]
    noise += [f"<div class='{c}'><p>buy or read this {c}</p></div>" for c in ("cookie-notice", "sidebar", "ad", "related", "comment-list", "share buttons")] + ["<!-- <p>no</p> -->"]
    for turn in range(300):
        lines, body = [], ""
        for i in range(int(rng.integers(1, 12))):
            text = prose(turn * 20 + i, int(rng.integers(30, 60)))
            lines.append(text + " & <b")
            spaced = text.replace(" ", (" ", "\n\t", " &nbsp;", "<i> </i>", "<!-- x > --> ")[int(rng.integers(5))])
            block = f"<{(tag := ('p', 'h2', 'div', 'blockquote', 'li', 'section')[int(rng.integers(6))])}>{spaced} &amp; &lt;b" + f"</{tag}>" * (tag not in ("p", "li") or rng.random() < 0.5)
            deep = int(rng.integers(0, 4))
            body += "<div class=x>" * deep + block + "</div>" * deep
            if rng.random() < 0.4:
                body += noise[int(rng.integers(len(noise)))]
        kind = ("<article class='post no-sidebar'>{}</article>", "<main><div class='has-comments'>{}</div></main>", "<div id=content>{}</div>")[turn % 3]
        page = "<html><head><title>t</title></head><body class='with-sidebar'>" + "".join(rng.choice(noise, 3)) + kind.format(body) + "".join(rng.choice(noise, 3))
        made = html_text.Page(page)
        assert made.text([made.path_of(made.boxes("body")[0])]) == "\n".join(lines), page


@pytest.mark.parametrize("html", ["<div class=c><table><tr>" + "<td>x y" * 100_000, "<div>t" * 100_000, "<a b " * 100_000, "<div class=k>" * 50_000 + "text" + "</div>" * 50_000, "<div>" * 50_000 + "</span>" * 50_000 + "t"])
def test_large_pages_take_time_in_proportion(html):
    import time

    start = time.process_time()
    page = html_text.Page(html)
    page.text([page.path_of(page.best())])
    assert time.process_time() - start < 15  # seconds; with scans by element it was minutes


# ---- 5 quality


def brute_measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {i + j for i, t in enumerate(triples) if triples.count(t) > 1 for j in range(3)} if len(triples) < 3000 else set(range(len(w)))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_measures(spark, odd):
    known = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 9000")
    for df in (known, odd):
        got = quality.verdicts(df)
        texts = {(r.doc_id, hash(r.text)): r.text for r in df.collect()}
        ids = [r.doc_id for r in df.collect()]
        assert sorted(str(r.doc_id) for r in got.collect()) == sorted(map(str, ids))
        by = {}
        for r in got.collect():
            by.setdefault(r.doc_id, []).append(tuple(r[n] for n in NAMES))
        for (i, _), text in texts.items():
            assert brute_measures(text) in by[i], i
        assert all((n < 50 or 100 * rep > 50 * n) == r.base_failed for r in got.collect() for n, rep in [(r.n_words, r.n_repeat_words)])


def test_depleted_documents_go_and_copies_stay(table):
    menu = [f"menu entry {i} click here now {i}" for i in range(12)]
    docs = [(i, "\n".join([*menu, f"word{i} only"]), "shop") for i in range(40)]
    docs += [(100 + i, "\n".join([menu[0], prose(i, 70), prose(i + 1000, 30)]), "shop") for i in range(40)]
    docs += [(200 + i, "\n".join(prose(7 + j, 20) for j in range(4)), "copies") for i in range(60)]
    got = {r.doc_id: r.kept for r in quality.verdicts(table(*docs)).collect()}
    assert not any(got[i] for i in range(40)) and all(got[i] for i in got if i >= 100)


def brute_clean(docs, limit=quality.LIMIT_TEXTS, share=quality.LIMIT_SHARE):
    """(id, text without the template lines of its host) of the documents that stay."""
    key = lambda x: x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    sets = [(s, frozenset(key(x) for x in (t or "").split("\n") if x.strip(SPACE))) for _, t, s in docs]
    held, hosts = {}, {}
    for s, keys in set(sets):
        hosts[s] = hosts.get(s, 0) + 1
        for k in keys:
            held[s, k] = held.get((s, k), 0) + 1
    out = []
    for i, t, s in docs:
        lines = (t or "").split("\n")
        gone = [bool(x.strip(SPACE)) and held[s, key(x)] > max(limit, hosts[s] * share) for x in lines]
        n, left = len((t or "").split()), sum(len(x.split()) for x, g in zip(lines, gone) if not g)
        m = brute_measures(t)
        if n >= 50 and 100 * m[4] <= 50 * n and 100 * left >= 30 * n:
            out.append((i, t if t is None else "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out)


def test_template_lines_of_any_length_are_removed(table):
    notices = [prose(9000 + i, 30) for i in range(4)]
    docs = [(i, "\n".join([*notices, f"word{i}"]), "hot") for i in range(60)]  # nothing of their own
    docs += [(100 + i, "\n".join([prose(i, 70), " " + notices[i % 4].upper() + "\t", "", prose(i + 700, 20)]), "hot" if i % 2 else None) for i in range(60)]
    docs += [(200 + i, prose(3, 40) + "\n" + prose(4, 60), "copies") for i in range(50)]  # one document
    docs += [(300 + i, notices[0] + "\n" + prose(i, 50), "other") for i in range(quality.LIMIT_TEXTS)]  # not above the limit
    df = table(*docs)
    want = brute_clean(docs)
    assert {i for i, _ in want} == {i for i, _, _ in docs if i >= 100} and any(t != x for (i, t) in want for j, x, _ in docs if i == j)
    assert rows(quality.clean_documents(df), "doc_id", "text") == want
    _, template = quality.ruled(df)
    assert rows(quality.without_templates(df, template, most=0).where("doc_id >= 100"), "doc_id", "text") == want
    tight = quality.clean_documents(df, limit_texts=5, limit_share=0.0, min_kept_percent=0)
    assert rows(tight.where("doc_id >= 300"), "doc_id", "text") == [(i, t.split("\n")[1]) for i, t, _ in docs if i >= 300]


def test_quality_empty(spark, table, odd):
    assert quality.verdicts(table()).isEmpty()
    assert quality.stage(spark, odd, SF).columns == odd.columns


# ---- 6 mixing


def test_raking_fits_the_margins(spark):
    rng = np.random.default_rng(1)
    cells = [(f"s{a}", f"l{b}", c, int(rng.integers(1, 10_000))) for a in range(5) for b in range(3) for c in range(4) if (a + b + c) % 5]
    df = spark.createDataFrame(cells, "source string, lang string, topic long, tokens long")
    got = mixing.raked(df, Shared(spark)).toPandas()
    fit = {tuple(c[:3]): float(c[3]) for c in cells}
    total = sum(fit.values())
    want = []
    for d, power in enumerate(mixing.POWERS.values()):
        own = {}
        for c in cells:
            own[c[d]] = own.get(c[d], 0) + c[3]
        raw = {k: (v / total) ** power for k, v in own.items()}
        want.append({k: v / sum(raw.values()) * total for k, v in raw.items()})
    for _ in range(300):
        for d in range(3):
            have = {}
            for k, v in fit.items():
                have[k[d]] = have.get(k[d], 0) + v
            fit = {k: v * want[d][k[d]] / have[k[d]] for k, v in fit.items()}
    for r in got.itertuples():
        assert r.fitted == pytest.approx(fit[r.source, r.lang, r.topic], rel=1e-4)


def test_raking_says_what_it_missed(spark):
    """Two cells that share no margin value cannot have different shares of their own source and language."""
    df = spark.createDataFrame([("a", "x", 0, 100), ("b", "y", 0, 100)], "source string, lang string, topic long, tokens long")
    targets = {d: spark.createDataFrame(v, "value string, share double") for d, v in (("source", [("a", 0.8), ("b", 0.2)]), ("lang", [("x", 0.5), ("y", 0.5)]))}
    got = mixing.raked(df, Shared(spark), targets=targets)
    assert all(r.margin_gap > 0.1 for r in got.collect())
    assert mixing.raked(df, Shared(spark)).agg(F.max("margin_gap")).first()[0] < mixing.TOLERANCE
    none = spark.createDataFrame([("a", "x", 0, 0), ("b", "y", 0, 50)], df.schema)
    got = mixing.raked(none, Shared(spark), targets={"source": targets["source"]}).where("source = 'a'").first()
    assert got.margin_gap == 1.0 and got.fitted == 0


def test_mixing_keeps_the_expected_tokens(spark, odd, table):
    docs = table(*[(i, prose(i, 20 + i % 50), "big" if i % 3 else f"s{i % 7}") for i in range(3000)])
    shared = Shared(spark)
    labelled = mixing.labelled(docs)
    cells = mixing.calibrated(shared.put(mixing.cells_of(labelled)), shared)
    kept = mixing.drawn(labelled, cells)
    tokens, expected, drawn = kept.agg(F.sum("mix_tokens"), F.sum(F.col("mix_tokens") * F.col("probability")), F.sum(F.when(F.col("kept"), F.col("mix_tokens")))).first()
    assert expected == pytest.approx(mixing.KEEP * tokens, rel=1e-6) and drawn == pytest.approx(expected, rel=0.06)
    assert kept.where("probability <= 0 or probability > 1").isEmpty()
    out = mixing.stage(spark, odd, SF)
    assert out.columns == odd.columns and mixing.stage(spark, table(), SF).isEmpty()


# ---- 7 top-k


def test_top_k(spark):
    rng = np.random.default_rng(2)
    vectors = [(int(i), rng.normal(size=8).round(2).tolist()) for i in rng.permutation(700)]
    vectors += [(900, None), (1000, []), (1100, [1.0] * 3), (1101, [0.5] * 3), (1200, [float("nan")] * 8), (1201, [None] + [1.0] * 7), (None, [1.0] * 8), (650, [3.0] * 8), (650, [3.0] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    ok = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in sorted({(q, tuple(a)) for q, a in ok if q % 100 == 0}):
        best = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in ok if c != q and len(b) == len(a))[:10]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    q = df.where("vec_id % 100 = 0").distinct()
    for shard, block in ((4096, 1024), (16, 3)):
        topk.SHARD, topk.BLOCK = shard, block
        assert rows(topk.top_k(df, q), "query_id", "rank", "vec_id", "score") == sorted(want)
    topk.SHARD, topk.BLOCK = 4096, 1024
    assert topk.top_k(df, q.limit(0)).isEmpty() and topk.top_k(df.limit(0), q).isEmpty()


def test_large_scores_are_exact():
    big = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**20, 0.0]])
    assert topk._product(*big).tolist() == [[2**60 + 1, 2**60]]


# ---- 8 BPE


def test_bpe_is_the_librarys(spark, odd):
    from tokenizers import Tokenizer

    own, ref = bpe.codec(bpe.word_file()), Tokenizer.from_file(bpe.word_file())
    texts = ["Hello  world's café\n\tÀb 12 !!?", "<|endoftext|> a <|startoftext|>b<|END", "ΑΣ İx ΣΑΣ", "日本 ​\x00 \x1c\x85x y", "é Å ﬁ ½ ²٣", "'S don'T we'LL 'LL'd", "a" * 500, "🙂👍🏽 x", "ǅ Ω ẞ ŉ"]
    texts += [r.text or "" for r in odd.collect() if len(r.text or "") < 1000] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    for text in texts:
        ids = ref.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == ref.decode(ids, skip_special_tokens=False)


def test_segment_tree_takes_the_leftmost_lowest():
    tree = bpe.SegmentTree([(r << bpe.RANK) + (i << bpe.PLACE) for i, r in enumerate([5, 2, 7, 2, 9])])
    place = lambda: tree.node[1] >> bpe.PLACE & 0xFFFFFF
    assert place() == 1
    tree.set(0, bpe.NONE, 1, bpe.NONE, 2, bpe.NONE)
    assert place() == 3


def test_bpe_raises_beyond_its_bits(monkeypatch, tmp_path):
    import json

    own = bpe.WordBpe(bpe.word_file())
    monkeypatch.setattr(bpe, "MAX_WORD", 20)
    assert own.encode_word("a" * 20)
    with pytest.raises(ValueError, match="a word of 21 bytes"):
        own.encode_word("a" * 21)
    with open(bpe.word_file(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"]["one too many"] = 1 << 16
    (tmp_path / "large.json").write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="below 65,536"):
        bpe.WordBpe(str(tmp_path / "large.json"))


def test_bpe_odd_rows(odd, table):
    got = bpe.encoded(odd, bpe.word_file())
    none = hashlib.sha256(b"").hexdigest()
    assert rows(got.where("doc_id in (1, 2, 3)"), "n_tokens", "ids_sha256", "decoded_sha256") == [(0, none, none)] * 3
    assert got.count() == odd.count() and bpe.encoded(table(), bpe.word_file()).isEmpty()


# ---- 9 lines


def brute_lines(texts, least):
    key = lambda x: x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})
    count = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for t in texts:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if not key(x) or count[key(x)] < least]
        out.append((len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_line_dedup(spark, table, odd, most):
    docs = [(i, f"{prose(i, 5)}\n Common Line É\t\nrare{i % 9}\n\r{i}\nCOMMON line É{'x' * (i % 3)}") for i in range(40)]
    shared = Shared(spark)
    for df, least in ((table(*docs), 10), (odd, 2), (odd, 1)):
        frequent = lines.frequent_keys(df, shared, min_docs=least)
        got = lines.without_lines(df, frequent, with_text=False, most=most)
        assert rows(got, "n_lines", "n_dropped", "kept_sha256") == brute_lines([r.text for r in df.collect()], least)
        text = lines.without_lines(df, frequent, most=most)
        assert text.columns == df.columns
        assert sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in text.collect()) == sorted(x[2] for x in brute_lines([r.text for r in df.collect()], least))
    assert lines.without_lines(table(), lines.frequent_keys(table(), shared)).isEmpty()


def test_runs_are_compacted(spark):
    runs = lines.LineRuns(Shared(spark), enough=3)
    for i in range(5):
        runs.add(spark.createDataFrame([(k,) for k in range(i, i + 3)], "key long"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert rows(runs.frequent(), "key") == [(2,), (3,), (4,)]


# ---- 10 passages


def test_every_repeated_run_is_found(table):
    shared = prose(500, 130).split()
    docs = [(i, prose(i, 90)) for i in range(30)]
    docs += [(100 + i, f"{prose(i + 50, 40)} {' '.join(shared[i:i + 60])} {prose(i + 80, 30)}") for i in range(8)]
    fuzzy = shared[60:125]
    fuzzy[30] = "changed"
    docs += [(200, f"{prose(900, 30)} {' '.join(fuzzy)}"), (201, " ".join(shared[40:])), (300, prose(3, 90)), (400, prose(901, 45)), (401, prose(901, 45) + " " + prose(902, 45))]
    w = {i: words(t) for i, t in docs}
    where = {}
    for i, x in w.items():
        for j in range(len(x) - 50):
            where.setdefault(tuple(x[j:j + 51]), set()).add(i)
    got = {}
    for r in passages.repeated_passages(table(*docs)).collect():
        assert r.n_words >= 50 and r.source_doc_id != r.doc_id
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for i, x in w.items():
        for j in range(len(x) - 50):
            if len(where[tuple(x[j:j + 51])]) > 1:
                assert set(range(j, j + 51)) <= got[i], i
    clean = {i for i in range(30) if i != 3} | {400, 401}
    assert not clean & set(got) and len(got[200]) >= 60


def test_seeds_stand_in_every_window_and_are_few_in_repeated_words():
    draw = np.random.default_rng(7)
    for kinds in (1, 2, 5, 1 << 40) * 40:
        kmers = draw.integers(0, kinds, int(draw.integers(1, 300))).astype(np.uint64)
        at = passages.winnowed(kmers)
        assert (np.diff(at) > 0).all()
        for i in range(max(1, len(kmers) - passages.WINDOW + 1)):
            part = kmers[i:i + passages.WINDOW]
            assert part.min() in kmers[at[(at >= i) & (at < i + len(part))]]
    assert len(passages.winnowed(np.zeros(8_000, np.uint64))) < 1_100


def test_repeated_words_of_any_length_are_one_passage(table):
    docs = [(i, f"{prose(8000 + i, 30)} {'again ' * n}{prose(8100 + i, 30)}") for i, n in enumerate((8, 60, 400, 400, 3_000))]
    got = {(r.doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(table(*docs)).collect()}
    assert got == {(i, 30, 30 + n) for i, n in ((1, 60), (2, 400), (3, 400), (4, 3_000))}


def test_chains_take_ordered_anchors():
    line = [(i, 100 + i) for i in range(0, 60, 6)]
    assert passages.chains(line + [(20, 5), (40, 7)])[0] == (0, 62, 100, 162)
    assert sorted(passages.chains([(0, 0), (8, 8), (50, 50)])) == [(0, 16, 0, 16), (50, 58, 50, 58)]


def test_passages_are_the_same_by_broadcast_and_by_packed_texts(spark, table, monkeypatch):
    """Few places are asked for by broadcast; for many, texts travel packed.  Repeated rows are asked once."""
    shared = [prose(50 + i, 90) for i in range(4)]
    docs = [(i, f"{prose(200 + i, 30)} {shared[i % 4]} {prose(300 + i, 40)} é🙂") for i in range(12)] + [(90, None), (91, ""), (None, shared[0])]
    df = table(*docs, docs[3], docs[3], docs[5])
    asked, old = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema, *a: asked.append((self, schema)) or old(self, run, schema, *a))
    columns = ("doc_id", "start_word", "end_word", "source_doc_id", "n_links")
    want = rows(passages.repeated_passages(df), *columns)
    assert len(want) > 12 and not any("packed" in schema for _, schema in asked)
    monkeypatch.setattr(passages, "WANTED", 3)
    assert rows(passages.repeated_passages(df), *columns) == want
    # whole texts are in no shuffle but that of the repeated rows
    sent = [self for self, schema in asked if "want long" in schema][-1]
    assert "packed" in sent.columns and "text" not in sent.columns


def test_rows_left_out_by_bits(spark):
    """Numbers as Spark gives them to rows: the others stay where they are, without a shuffle of them."""
    ids = [(p << 33) + i for p in (0, 1, 7) for i in (0, 1, 2, 7, 8, 9, 32767, 32768, 32769, 40000)]
    wide = spark.createDataFrame([(i, "x" * 9) for i in ids], "doc long, rest string")
    gone = spark.createDataFrame([(i,) for i in ids[::3]], "doc long")
    left = passages._without(wide, gone, passages.Shared(spark))
    assert rows(left, "doc", "rest") == sorted((i, "x" * 9) for i in set(ids) - set(ids[::3]))
    assert left.columns == wide.columns and "hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()
    assert passages._without(wide, gone.where("doc < 0"), passages.Shared(spark)).count() == len(ids)


def test_passages_odd_rows(odd, table):
    got = passages.repeated_passages(odd)
    assert set(got.columns) == {"doc_id", "start_word", "end_word", "n_words", "source_doc_id", "n_links"}
    assert got.where("doc_id in (1, 2, 3, 11)").isEmpty()
    assert passages.repeated_passages(table()).isEmpty()


def test_edits_of_several_words_are_crossed(table):
    docs, want = [], {}
    for m in range(2, 6):
        for at in range(0, 61 - m, 3):
            key = 1000 * m + at
            whole = prose(3 * key, 60).split()
            other = prose(3 * key + 1, m).split()
            docs.append((10 * key, " ".join(prose(5 * key + 4, 20).split() + whole + prose(5 * key + 6, 20).split())))
            for k, fresh in enumerate((other, other[:1], other + ["added"] * (5 - m))):
                i = 10 * key + k
                x = whole[:at] + fresh + whole[at + m:]
                docs.append((i + 1, " ".join(prose(7 * i + 2, 20).split() + x + prose(7 * i + 3, 20).split())))
                # an edit with under four words to the end of the passage is not crossed
                low, high = (at + len(fresh) if at < 4 else 0), (at if at + m > 56 else len(x))
                if high - low >= 50:
                    want[i + 1] = set(range(20 + low, 20 + high))
    got = {}
    for r in passages.repeated_passages(table(*docs)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert len(want) > 100 and not {i for i, w in want.items() if not w <= got.get(i, set())}


def test_a_passage_twice_in_any_document(table):
    once = prose(4001, 60)
    docs = [f"{prose(4100 + 3 * i, 30)} {once} {prose(4101 + 3 * i, 40)} {once} {prose(4102 + 3 * i, 30)}" for i in range(3)]
    for order in (docs, docs[:1] + [f"{prose(4200, 30)} {once} {prose(4201, 30)}"]):
        for first in (order, order[::-1]):
            got = {(r.doc_id, r.start_word, r.end_word) for r in passages.repeated_passages(table(*enumerate(first))).collect()}
            assert got == {(i, s, s + 60) for i, t in enumerate(first) for s in ((30, 130) if t in docs else (30,))}


def test_runs_beyond_the_pivot_are_whole(table):
    docs, want = [], {}
    for i in range(40):
        run, size, cut = prose(6000 + i, 80).split(), 50 + i % 25, 23 + i % 26
        share = run[:cut] if i % 2 else run[size - cut:size]
        docs.append((10 * i, f"{prose(7000 + i, 30)} {' '.join(share)} {prose(7100 + i, 30)}"))
        for k in range(1, 4):
            docs.append((10 * i + k, f"{prose(7200 + 10 * i + k, 25)} {' '.join(run[:size])} {prose(7700 + 10 * i + k, 25)}"))
            want[10 * i + k] = set(range(25, 25 + size))
    got = {}
    for r in passages.repeated_passages(table(*docs)).collect():
        assert r.source_doc_id != r.doc_id
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert not {i: len(w - got.get(i, set())) for i, w in want.items() if not w <= got.get(i, set())}
