import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import langid, lines, pitman_yor, toxicity


# --- toxicity -----------------------------------------------------------------


def slow_segments(s):
    """Maximal segments by definition: positive, no longer or shorter interval within reach scores more (Ruzzo and Tompa, recursive form)."""
    def inside(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += s[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                    best = (total, i, j + 1)
        if best is None:
            return []
        _, i, j = best
        return inside(a, i) + [(i, j)] + inside(j, b)

    return inside(0, len(s))


def test_segments_equal_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        s = np.array([rnd.choice([-3.0, -1.5, -1.0, 0.7, 1.1, 2.3, 5.0]) + rnd.random() * 1e-3 for _ in range(rnd.randint(0, 18))])
        got = toxicity.maximal_segments(s)
        assert [(a, b) for a, b, _ in got] == slow_segments(s)
        assert all(v == pytest.approx(s[a:b].sum()) for a, b, v in got)


def toxic_corpus(n=1500, seed=2):
    rnd = random.Random(seed)
    plain = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.15
        words = [rnd.choice(plain) for _ in range(rnd.randint(30, 120))]
        if bad:
            for at in rnd.sample(range(len(words)), 4):
                words[at] = rnd.choice(["vilest", "scummy", "Filthy", "filthier"])
        docs.append((i, " ".join(words), "en"))
        labels.append((i, 1 if bad else 0))
    docs += [(n, None, "x"), (n + 1, "", "x"), (None, "no id", "x"), (n + 2, "word1 " * 50_000, "x")]
    return docs, [*labels, (n, None), (None, 1)]


def test_toxicity_held_out_accuracy(spark):
    docs, labels = toxic_corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score_documents(d, lab).collect()
    assert len(out) == len(docs)
    truth = dict(labels[:-2])
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    hit = sum(r.predicted and truth[r.doc_id] for r in held)
    assert hit >= 0.95 * sum(truth[r.doc_id] for r in held) and hit >= 0.95 * sum(r.predicted for r in held)
    assert all(0 <= r.score <= 1 for r in out)
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {r.doc_id for r in out if not r.predicted}


def test_passages_are_found(spark):
    docs, labels = toxic_corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, x string")
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    text = " ".join(["word1"] * 100 + ["vilest", "scummy", "filthy"] + ["word2"] * 100)
    found = toxicity.passages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert [(r.first_word, r.last_word, r.passage) for r in found] == [(100, 102, "vilest scummy filthy")]


def test_calibration_sees_all_passages(spark):
    docs, labels = toxic_corpus()
    texts = {d: t for d, t, *_ in docs if d is not None}
    truth = {d: y for d, y in labels if y in (0, 1) and d in texts}
    bad = [d for d, y in truth.items() if y][::2]
    d = spark.createDataFrame([(i, " ".join([texts[i] or ""] * (80 if i in bad else 1))) for i in truth], "doc_id long, text string")
    lab = spark.createDataFrame(list(truth.items()), "doc_id long, toxic int")
    model = toxicity.train(d, lab, F.lit(True))
    held = toxicity._sample(d, lab, "doc_id", "text", "toxic", F.lit(True), toxicity.SAMPLE_ROWS).where("part = 2").collect()
    x, most = [], 0
    for r in held:
        words = toxicity._words(r.text)
        best, total, many = toxicity.significance(toxicity.maximal_segments(toxicity.word_scores(words, model)), max(1, len(words)), model)
        x.append((best, total))
        most = max(most, many)
    assert most > 50
    want = toxicity._logistic(np.log1p(np.array(x)), np.array([r.label for r in held], float))
    assert np.allclose(model.weights, want, rtol=1e-6)


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(d, none).count() == 2
    assert toxicity.score_documents(d.limit(0), none).count() == 0


def test_without_both_classes_scores_are_the_base_rate_and_all_stay(spark):
    docs, _ = toxic_corpus(60)
    d = spark.createDataFrame(docs, "doc_id long, text string, x string")
    for label, rate in ((None, 0.0), (0, 0.0), (1, 1.0)):
        lab = spark.createDataFrame([(i, label) for i in range(60)], "doc_id long, toxic int")
        out = toxicity.score_documents(d, lab).collect()
        assert {(r.score, r.predicted) for r in out} == {(rate, int(rate))}
        assert toxicity.drop_toxic(d, lab).count() == len(docs)


def test_scores_equal_brute_force(spark):
    docs, labels = toxic_corpus(600)
    d = spark.createDataFrame(docs[:-1], "doc_id long, text string, x string")
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert all(x >= 0 for x in model.weights[1:])
    for r in toxicity.score(d, model).collect():
        words = "".join(c.lower() if c.isascii() else c for c in dict((i, t) for i, t, _ in docs)[r.doc_id] or "").split()
        s = [(model.words[w] if w in model.words else model.beginnings.get(w[:5], 0.0)) - toxicity.DRIFT for w in words]
        bits = [model.lam * sum(s[a:b]) - math.log(model.k * len(words)) for a, b in slow_segments(s)]
        best, total = max([0.0, *bits]), sum(b for b in bits if b > -math.log(toxicity.EXPECTED))
        a, b, c = model.weights
        assert r.score == pytest.approx(1 / (1 + math.exp(-(a + b * math.log1p(best) + c * math.log1p(total)))), abs=1e-9)


def test_slopes_are_never_negative():
    rnd = np.random.default_rng(1)
    x = rnd.random((400, 2))
    w = toxicity._logistic(x, (x[:, 0] - x[:, 1] + 0.2 * rnd.standard_normal(400) > 0).astype(float))
    assert w[1] > 0 and w[2] == 0


# --- language model -----------------------------------------------------------


def lm_docs():
    """Texts in two languages without common words, so that a word tells much about the next."""
    rnd = random.Random(9)
    say = lambda x, n: " ".join(f"{x}{int(rnd.paretovariate(0.7)) % 500}" for _ in range(n))
    docs = [(i, say("en"[i % 2], 60)) for i in range(300)]
    docs = [(i, t.title() if i % 3 else t) for i, t in docs]
    return [*docs, (300, None), (301, ""), (302, "unseenword " * 3), (None, "e1 n2"), (3, docs[3][1])]


def test_base_score_equals_brute_force(spark):
    docs = lm_docs()
    out = pitman_yor.score_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    tokens = lambda t: [*(t or "").encode().translate(pitman_yor.LOWERING).split(), b"\n"]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for d, t in docs:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))
        want[(d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)
    both = {r.held_out: r for r in pitman_yor.perplexity(spark.createDataFrame(out)).collect()}
    assert both[True].perplexity < both[True].base_perplexity


def run_rounds(docs, sweeps, burn_in, hyper, grid=pitman_yor.Grid(2, 2)):
    """The operator's rounds without Spark: (rows of every kind, samples, lexica)."""
    import pandas as pd

    by = lambda rows, f: pd.concat([f(g) for _, g in rows.groupby("dest")])
    of = lambda rows, *kinds: rows[rows["kind"].isin(kinds)]
    half = len(docs) // 2
    chunks = [r for i, part in enumerate((docs[:half], docs[half:])) for r in pitman_yor.chunk_rows((i + 1) << 36, [d for d, _ in part], [t for _, t in part], grid)]
    merged = by(pitman_yor._frame(chunks), lambda g: pitman_yor.merge(g, grid))
    rows, state, samples, lexica, fixed = merged, of(merged, pitman_yor.STATE), [], [], hyper is not None
    hyper, first = hyper or pitman_yor.Hyper(), None
    for s in range(sweeps + 1):
        told = by(of(rows, pitman_yor.MESSAGE), lambda g: pitman_yor.reduce(g, s, hyper))
        stats = of(pd.concat([rows, told]), pitman_yor.STAT).groupby("dest")["n"].sum().to_dict()
        first = first or stats
        hyper = pitman_yor.new_hyper(hyper, {**first, **stats}, s, fixed)
        if s > burn_in:
            samples.append(hyper)
        if not s or s > burn_in:
            lexica.append(of(told, pitman_yor.LEXICON))
        if s < sweeps:
            rows = by(pd.concat([state, of(told, pitman_yor.REPLY)]), lambda g: pitman_yor.sweep_cell(g, s, hyper, grid, s >= burn_in))
            state = of(rows, pitman_yor.STATE)
    tokens = of(merged, pitman_yor.TOKENS)
    answers = by(pd.concat([of(merged, pitman_yor.COUNTS, pitman_yor.WHERE), state]), pitman_yor.answer_pairs)
    asked = []
    for t in tokens.itertuples():
        words = np.sort(pitman_yor.unpack(t.data)[4])
        for d in np.unique(grid.reducer(words)):
            asked.append((int(d), pitman_yor.REQUEST, t.dest, pitman_yor.pack(words[grid.reducer(words) == d]), 0.0))
    words = by(pd.concat([pitman_yor._frame(asked), *lexica]), lambda g: pitman_yor.answer_words(g, len(samples)))
    n, texts = int(first[pitman_yor.TOTAL + 3]), int(first[pitman_yor.TOTAL + 4])
    return by(pd.concat([tokens, answers, words]), lambda g: pitman_yor.score_chunk(g, grid, samples, n, texts)), samples


def plain_scores(docs, sweeps, burn_in, hyper):
    """A plain sampler: every customer leaves its table and is seated anew, one after the other."""
    d, s, d0, s0 = hyper[:4]
    rnd = random.Random(3)
    split = lambda t: [*(t or "").encode().translate(pitman_yor.LOWERING).split(), b"\n"]
    texts = [split(t) for x, t in docs if not pitman_yor.is_held_out(x)]
    pairs = [(u, w) for t in texts for u, w in zip([b"^", *t], t)]
    known = {w for _, w in pairs}
    seats, total, opened = {}, Counter(), Counter()  # tables of (context, word), customers and tables by context; None: the parent
    base = 1 / (len(known) + 1)

    def p(u, w):
        if u == "base":
            return base
        sizes = seats.get((u, w), [])
        a, b = (d0, s0) if u is None else (d, s)
        return (max(sum(sizes) - a * len(sizes), 0) + (b + a * opened[u]) * p("base" if u is None else None, w)) / (b + total[u])

    def sit(u, w):
        a, b = (d0, s0) if u is None else (d, s)
        sizes = seats.setdefault((u, w), [])
        new = (b + a * opened[u]) * p("base" if u is None else None, w)
        at = rnd.random() * (sum(sizes) - a * len(sizes) + new)
        for i, n in enumerate(sizes):
            at -= n - a
            if at < 0:
                sizes[i] += 1
                break
        else:
            sizes.append(1)
            opened[u] += 1
            if u is not None:
                sit(None, w)
        total[u] += 1

    def leave(u, w):
        sizes = seats[u, w]
        i = rnd.choices(range(len(sizes)), sizes)[0]
        sizes[i] -= 1
        total[u] -= 1
        if not sizes[i]:
            del sizes[i]
            opened[u] -= 1
            if u is not None:
                leave(None, w)

    for u, w in pairs:
        sit(u, w)
    sums = [[0.0] * len(split(t)) for _, t in docs]
    for i in range(sweeps):
        for u, w in pairs:
            leave(u, w)
            sit(u, w)
        if i >= burn_in:
            for out, (_, t) in zip(sums, docs, strict=True):
                for j, (u, w) in enumerate(zip([b"^", *split(t)], split(t))):
                    out[j] += p(u, w)
    return [sum(math.log10(x / (sweeps - burn_in)) for x in out) for out in sums]


def test_scores_equal_a_plain_sampler():
    rnd = random.Random(12)
    say = lambda n: " ".join(f"w{int(rnd.paretovariate(0.8)) % 40}" for _ in range(n))
    docs = [(i, say(rnd.randint(5, 25))) for i in range(120)]
    docs += [(500, None), (501, "w1 w2 unseen w3"), (None, "w1 w1 w1 w1")]
    hyper = pitman_yor.Hyper(d=0.6, s=1.5, d0=0.4, s0=2.0)
    got, _ = run_rounds(docs, 240, 40, hyper)
    want = plain_scores(docs, 240, 40, hyper)
    place = {d: i for i, (d, _) in enumerate(docs)}
    apart = []
    for doc, score in zip(got["doc_id"].astype(object), got["score"], strict=True):
        expected = want[place[doc if isinstance(doc, int) else None]]
        assert score == pytest.approx(expected, rel=0.02, abs=0.05)
        apart.append(score / expected - 1)
    assert abs(np.mean(apart)) < 0.003


def test_discounts_and_strengths_are_found_again():
    """Texts drawn from a Pitman-Yor restaurant: the sampled discount of its customers comes near to the true one."""
    rnd = random.Random(2)
    sizes, d, s = [], 0.6, 5.0
    for n in range(3000):
        if rnd.random() * (s + n) < s + d * len(sizes):
            sizes.append(1)
        else:
            sizes[rnd.choices(range(len(sizes)), [x - d for x in sizes])[0]] += 1
    counts = np.array(sizes)
    stats = dict(pitman_yor.seating_stats(counts, np.ones(len(counts), np.int64), pitman_yor.PARENT))
    stats |= {pitman_yor.TOTAL: float(counts.sum()), pitman_yor.TOTAL + 1: float(len(counts))}
    rng = np.random.default_rng(0)
    evidence, x, seen = pitman_yor.Evidence(stats, pitman_yor.PARENT), (0.5, 1.0), []
    for _ in range(60):
        x = evidence.sample(*x, rng)
        seen.append(x)
    assert np.mean([a for a, _ in seen[20:]]) == pytest.approx(d, abs=0.1)


def test_held_out_perplexity_gains_from_contexts():
    docs = lm_docs()
    got, samples = run_rounds(docs, 5, 2, None)
    held = got[got["held_out"]]
    assert len(samples) == 3 and all(0 < h.d < 1 and h.s > 0 for h in samples)
    assert held["score"].sum() > 0.95 * held["base_score"].sum()


def test_the_parent_is_a_distribution():
    rng = np.random.default_rng(4)
    customers = rng.integers(1, 50, 30)
    tables = rng.integers(1, customers + 1)
    h = pitman_yor.Hyper(d0=0.7, s0=2.5, customers=float(customers.sum()), tables=float(tables.sum()), words=30.0)
    assert h.parent(customers, tables).sum() + h.parent(0, 0) == pytest.approx(1)


def test_table_counts_follow_their_conditional():
    d, theta, others, base, c = 0.6, 1.2, 3, 0.15, 5
    rng = np.random.default_rng(0)
    n = 200_000
    drawn = pitman_yor.draw_tables(np.full(n, c), np.full(n, math.log(base)), np.full(n, others), d, theta, pitman_yor.stirling(d, 8), rng)
    drawn = np.bincount(drawn, minlength=c + 1)[1:] / n

    def weigh(sizes, left):
        """Weights by number of tables of all seatings, customer by customer."""
        if not left:
            return {len(sizes): 1.0}
        out = Counter()
        for i in range(len(sizes)):
            for t, w in weigh((*sizes[:i], sizes[i] + 1, *sizes[i + 1 :]), left - 1).items():
                out[t] += w * (sizes[i] - d)
        for t, w in weigh((*sizes, 1), left - 1).items():
            out[t] += w * (theta + d * (others + len(sizes))) * base
        return out

    exact = weigh((), c)
    total = sum(exact.values())
    assert drawn == pytest.approx([exact[t] / total for t in range(1, c + 1)], abs=0.005)


@pytest.mark.parametrize("d", [0.3, 0.6, 0.85])
@pytest.mark.parametrize("base", [0.001, 0.05, 0.5])
def test_many_customers_follow_the_same_conditional(d, base):
    c, n = 1800, 60_000
    exact = pitman_yor.stirling(d, c)[c, 1:] + np.cumsum(np.log((1.0 + d * (10 + np.arange(c))) * base))
    exact = np.exp(exact - exact.max())
    drawn = pitman_yor.draw_tables(np.full(n, c), np.full(n, math.log(base)), np.full(n, 10), d, 1.0, pitman_yor.stirling(d), np.random.default_rng(1))
    drawn = np.bincount(drawn, minlength=c + 1)[1 : c + 1] / n
    assert 0.5 * np.abs(drawn - exact / exact.sum()).sum() < 0.05


def test_arrays_are_packed_and_unpacked():
    arrays = [np.array([], np.uint64), np.array([1, 2, 1 << 60], np.uint64), pitman_yor.small(np.array([0, 70_000])), np.array([-1], np.int64)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, pitman_yor.unpack(pitman_yor.pack(*arrays)), strict=True))


def test_language_model_empty(spark):
    assert pitman_yor.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- lines and languages --------------------------------------------------------


def site_pages():
    rows = []
    for i in range(40):
        body = f"<nav><a href='/'>Home</a></nav><p>story {i}</p><p>story {i}</p><p>shared <b>bold</b>  text</p>" if i % 2 else f"<div>Home</div><p>other {i}</p>"
        rows.append((i, f"http://{'A' if i < 30 else 'b'}.org/{i}", f"<html lang=en><script>var x='<p>';</script>{body}<!-- c --></html>", "x"))
    return [*rows, (40, None, None, "x"), (41, "", "", "x"), (42, "http://b.org/", "<p>" + "long " * 60_000 + "</p>", "x"), (3, *rows[3][1:])]


def test_lines_equal_brute_force(spark):
    import re

    rows = site_pages()
    got = lines.strip_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string, lines string")).collect()

    def split(h):
        h = re.sub(r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->", "", h or "")
        h = re.sub(r"(?i)</?(?:a|abbr|b|code|em|font|i|small|span|strong|sub|sup|u)(?:\s[^>]*)?>", "", h)
        runs = [re.sub(r"\s+", " ", x).strip() for x in re.sub(r"<[^>]*>", "\n", h).split("\n")]
        return [x for x in runs if x]

    host = lambda u: (re.match(r"\w+://([^/:?#]+)", u or "") or [None, ""])[1].lower()
    pages = Counter(host(u) for _, u, *_ in rows)
    seen = Counter((host(u), x) for _, u, h, _ in rows for x in set(split(h)))
    drop = {k for k, n in seen.items() if n >= 3 and n / pages[k[0]] > lines.RATIO}
    want = []
    for p, u, h, _ in rows:
        own = split(h)
        kept = [x for x in own if (host(u), x) not in drop]
        want.append((p, host(u), len(own), len(own) - len(kept), "\n".join(kept)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert ("a.org", "Home") in drop and ("a.org", "shared bold text") in drop


def test_lines_stay_native(spark):
    df = spark.createDataFrame(site_pages(), "page_id long, url string, html string, lines string")
    plan = lines.strip_boilerplate(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert lines.strip_boilerplate(df.limit(0)).count() == 0


def test_languages_by_text_and_fusion(spark):
    rnd = random.Random(4)
    vocabulary = {"en": "the and of ing tion with house water".split(), "de": "der die und schaft keit wasser haus über".split(), "fr": "le la les tion eau maison être où".split()}
    say = lambda x, n: " ".join(rnd.choice(vocabulary[x]) for _ in range(n))
    docs = [(i, say(x, 40), x) for i, x in enumerate(["en", "de", "fr"] * 40)] + [(None, "x", "en"), (500, None, "en"), (501, "x", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    pages = [(i, f"http://site.{'de' if x == 'de' else 'com'}/{i}", f"<html lang='{x}'><p>{say(x, 30)}</p>", x) for i, x in enumerate(["en", "de", "fr"] * 30)]
    # No text of its own: the declaration, the suffix and the host speak.
    pages += [(90, "http://only.de/", "<html lang=de></html>", "de"), (91, "http://site.de/x", None, "de"), (92, None, None, None), (93, "http://site.com/w", f"<html lang=de><p>{say('fr', 60)}</p>", "fr")]
    p = spark.createDataFrame(pages, "page_id long, url string, html string, lang string")
    got = {r.page_id: r for r in langid.identify(p, d).collect()}
    assert len(got) == len(pages)
    assert all(got[i].lang == x for i, _, _, x in pages if x)
    assert all(0 <= r.confidence <= 1 + 1e-9 for r in got.values())
    # The fusion against a plain version over the text evidence.
    langs, table = langid.fit(d)
    seen = langid.text_evidence(p, langs, table).collect()
    soft = lambda x: [math.exp(v - max(x)) / sum(math.exp(u - max(x)) for u in x) for v in x]
    mass = [[round(v, 9) for v in soft(r.ll)] for r in seen]
    total, n = len(seen), len(langs)
    whole = [sum(m[i] for m in mass) for i in range(n)]
    said = [(r, m) for r, m in zip(seen, mass, strict=True) if r.declared]
    trust = (sum(m[langs.index(r.declared)] for r, m in said) + 2) / (len(said) + 3)
    for r, own in zip(seen, mass, strict=True):
        logs = []
        for i, x in enumerate(langs):
            others = lambda c: [m[i] for q, m in zip(seen, mass, strict=True) if q is not r and q[c] == r[c]]  # noqa: B023, E731
            suffix = (sum(others("suffix")) + 1.0) / (whole[i] - own[i] + 2.0)
            domain = (sum(others("domain")) + 10 * (whole[i] + 1) / (total + n)) / (len(others("domain")) + 10)
            host = (sum(others("host")) + 5 * domain) / (len(others("host")) + 5)
            logs.append(r.ll[i] + (0 if r.declared is None else math.log(trust if r.declared == x else (1 - trust) / (n - 1))) + math.log(suffix) + math.log(host))
        post = soft(logs)
        assert got[r.page_id].lang == langs[post.index(max(post))] and got[r.page_id].confidence == pytest.approx(max(post), abs=1e-6)
    assert langid.identify(p.limit(0), d).count() == 0
    assert {r.lang for r in langid.identify(p, d.limit(0)).collect()} == {None}
