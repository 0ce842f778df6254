"""Picks, reviews and audits against hand-computed cases and plain loops."""

import random

import pytest

from cuelattice.operators import alignment as P
from cuelattice.operators import folds as D
from cuelattice.operators import intervals as I
from cuelattice.operators import validate as V

PICK = "job long, id long, start double, end double, text string"
CHAR = "job long, s double, e double, w string"


def said(text, start=10.0, each=0.2, job=1):
    """A character each fifth of a second; a blank is a pause."""
    return [(job, round(start + k * each, 3), round(start + (k + 1) * each, 3), c) for k, c in enumerate(text) if c != " "]


def align(spark, picks, chars, **kw):
    kw = {"pad": (0.4, 0.6)} | kw
    return {r.id: r for r in P.align_picks(spark.createDataFrame([(1, k, float(a), float(b), t) for k, (a, b, t) in enumerate(picks)], PICK), spark.createDataFrame(chars, CHAR), **kw).collect()}


def test_longest_common():
    def length(a, b):
        best = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                best[i, j] = 0 if not i or not j else best[i - 1, j - 1] + 1 if a[i - 1] == b[j - 1] else max(best[i - 1, j], best[i, j - 1])
        return best[len(a), len(b)]

    rng = random.Random(7)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc", k=rng.randrange(9))) for _ in range(2))
        pairs = D.longest_common(a, b)
        assert len(pairs) == length(a, b) and all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_picks_are_found(spark):
    chars = said("甲乙丙丁戊己庚辛壬癸")  # 10 to 12 s
    got = align(spark, [(10.5, 11.3, "丙丁戊己")], chars)[0]
    assert (got["mode"], got.coverage, got.said, got.word_coverage) == ("char", 1.0, "丙丁戊己", 1.0)
    assert (got.start, got.end) == (10.4, 11.2)  # the neighbours leave no gap
    loose = align(spark, [(10.5, 11.3, "丙丁戊己")], said("甲乙 丙丁戊己 庚"))[0]
    assert (loose.start, loose.end) == (10.52, 11.58)


def test_words_said_before_the_text_are_dropped(spark):
    got = align(spark, [(10.2, 11.6, "姐妹们去搭白牛仔裤")], said("一去搭白牛仔裤二"))[0]
    assert (got["mode"], got.text, got.coverage) == ("char-3", "去搭白牛仔裤", 1.0)


def test_the_second_time_is_left_alone(spark):
    chars = said("充绒量不低 充绒量不低")
    got = align(spark, [(10.0, 11.0, "充绒量不低")], chars)[0]
    assert got.start == 9.92 and got.end == 11.18 and got.said == "充绒量不低"


def test_ladder_of_fallbacks(spark):
    chars = said("子丑寅卯辰巳午未")  # 10 to 11.6 s
    cores = spark.createDataFrame([(1, 9.9), (1, 11.7), (1, 30.0)], "job long, at double")
    assert align(spark, [(10, 11.6, "完全不同")], chars, cores=cores)[0]["mode"] == "snap"
    got = align(spark, [(10, 11.6, "完全不同")], chars)[0]
    assert (got["mode"], got.start, got.end, got.reason) == ("expand", 9.85, 11.85, None)
    blocked = align(spark, [(10.4, 11.0, "完全不同")], chars, banned="丑")[0]
    assert (blocked["mode"], blocked.reason, blocked.start) == ("skipped", "banned_neighbour", None)
    assert align(spark, [(10, 11, None), (20, 21, "")], [])[1]["mode"] == "expand"


def test_overlapping_picks_and_probe(spark):
    chars = spark.createDataFrame(said("甲乙丙丁戊己庚辛壬癸"), CHAR)
    picks = spark.createDataFrame([(1, 0, 10.0, 10.8, "甲乙丙丁"), (1, 1, 10.2, 11.0, "乙丙丁戊"), (1, 2, 11.2, 12.0, "庚辛壬癸"), (1, 3, 50.0, 51.0, "不在这里"), (2, 0, 10.0, 10.8, "甲乙丙丁"), (2, 1, None, 3.0, "空")], PICK)
    out = P.align_picks(picks, chars, pad=(0.4, 0.6))
    got = {(r.job, r.id): (r["mode"], r.clean) for r in P.probe(out, spark.createDataFrame([(1, 2, "banned_word")], "job long, id long, code string")).collect()}
    assert got == {(1, 0): ("char", True), (1, 1): ("skipped", False), (1, 2): ("char", False), (1, 3): ("expand", False), (2, 0): ("expand", False)}
    assert P.align_picks(picks.where("id > 9"), chars, pad=(0.4, 0.6)).count() == 0


UNIT = "job long, id long, start double, end double, topic string, claim long, strength double, relevance double, hook double, role string, needs array<long>, independent boolean, usable boolean, scene string"


def film(n=8, **change):
    """Units of 5 s each; change: column to a value by id."""
    base = lambda k: {"job": 1, "id": k, "start": 5.0 * k, "end": 5.0 * k + 5, "topic": "t", "claim": k, "strength": 0.8, "relevance": 0.9, "hook": 0.8, "role": "fit", "needs": [], "independent": True, "usable": True, "scene": None}
    return [base(k) | {c: v[k] for c, v in change.items() if k in v} for k in range(n)]


def test_audit_as_rows_and_as_a_loop(spark):
    rng = random.Random(3)
    films, want = [], {}
    for job in range(60):
        rows = film(rng.randrange(1, 9), scene={k: rng.choice(["a", "a", "a", None]) for k in range(8)}, strength={k: rng.choice([0.2, 0.8]) for k in range(8)}, relevance={k: rng.choice([0.5, 0.7]) for k in range(8)}, claim={k: rng.randrange(12) for k in range(8)}, needs={k: rng.choice([[], [], [rng.randrange(8)]]) for k in range(8)}, independent={0: rng.random() < 0.8})
        rows = [r | {"job": job, "end": r["start"] + rng.choice([4.0, 9.0])} for r in rows]
        films += rows
        want |= {(job, i, code): 1 for i, code in D.violations(rows, 12, 40)}
    units = spark.createDataFrame(films, UNIT)
    edges = units.selectExpr("job", "id", "explode(needs) as need")
    got = V.film_audit(units, edges, pos="id", low=12, high=40).collect()
    assert {(r.job, r.first, r.code) for r in got} == set(want) and len({c for _, _, c in want}) == 7


def review(spark, remarks, units=None):
    u = spark.createDataFrame(units or film(), UNIT)
    orders = D.arrange(u, low=15, high=20)
    first = orders.where("selected").collect()[0].ids
    said = spark.createDataFrame(remarks(first), "job long, attempt int, id long, reason string")
    return first, D.review_orders(u, orders, said, low=15, high=20).collect()[0]


def test_review_replaces_and_checks_again(spark):
    first, got = review(spark, lambda ids: [(1, 0, ids[1], "unclear")])
    assert got.passed and got.rounds == 2 and list(got.initial_ids) == list(first) and list(got.ids) != list(first)
    assert got.replaced[0].old == str(first[1]) and got.replaced[0].reason == "unclear" and 15 <= got.duration <= 20
    assert len(got.ids) == len(first) and first[1] not in got.ids


def test_review_is_bounded(spark):
    _, got = review(spark, lambda ids: [(1, None, None, "never good")])
    assert not got.passed and got.rounds == 3
    assert {r.reason for r in got.replaced} == {"whole_film"}
    first, got = review(spark, lambda ids: [(1, 0, 99, "not shown")])
    assert got.passed and got.rounds == 1 and not got.replaced and list(got.ids) == list(first)


@pytest.mark.parametrize("join", [I.nearest_join, I.tolerance_join])
def test_equal_and_null_points(spark, join):
    """Repeated rows stay as often as they come, null times without a match."""
    left = spark.createDataFrame([(1, 5.0, "a"), (1, 5.0, "a"), (1, 5.0, "b"), (1, None, "c"), (None, 5.0, "d")], "job long, t double, x string")
    right = spark.createDataFrame([(1, 5.01, 7), (1, 5.015, 3)], "job long, u double, r long")
    hits = {"nearest_join": 7, "tolerance_join": 3}[join.__name__]
    got = sorted((r[2], r[3]) for r in join(left, right, ["job"], "t", "u", "r", within=0.02).collect())
    assert got == [("a", hits), ("a", hits), ("b", hits), ("c", None), ("d", None)]


def test_long_texts_align_in_little_memory(spark):
    """a table of all pairs of places of two such texts has gigabytes; characters are never moved."""
    import tracemalloc

    rng = random.Random(1)
    a, b = ("".join(rng.choices("abcdefgh", k=20_000)) for _ in range(2))
    tracemalloc.start()
    pairs = D.longest_common(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and len(pairs) > 9000 and all(a[i] == b[j] for i, j in pairs)
    assert D.common_lengths(a[:300], b[:200], [0, 7, 299, 300]) == {i: len(D.longest_common(a[i:300], b[:200])) for i in (0, 7, 299, 300)}
    asked = spark.createDataFrame([(1, 5, "Ab, ç", [(1, 2, "a"), (2, 3, "."), (3, 4, "b!"), (4, 5, None), (5, 6, "Ç")]), (1, 6, None, [(1, 2, "a")])], "job long, id long, text string, chars array<struct<s:long,e:long,w:string>>")
    got = D.align_texts(asked)
    assert "Exchange" not in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.select("id", "coverage", "start", "end").collect())) == [(5, 1.0, 1.0, 6.0), (6, 0.0, None, None)]


def test_arrange_takes_jobs_together(spark, monkeypatch):
    """jobs are arranged in batches; orders, figures and ties are those of one job at a time."""
    rng = random.Random(11)
    rows = []
    for job in range(150):
        at = 0.0
        for k in range(rng.randrange(1, 9) if job else 11):
            span = rng.choice([1.1, 2.3, 3.7, 5.05, 9 * rng.random()])
            rows.append((job, 3 * k, at, at + span, rng.choice(["a", "b", None]), rng.randrange(9), rng.choice([0.1, 0.3, 0.7, rng.random()]), rng.choice([0.3, 0.5, 0.61, 0.9]), rng.choice([0.2, 0.5, 0.7, 0.9]), rng.choice(["x", "y", None]), [3 * rng.randrange(k + 1)] if rng.random() < 0.2 else [], rng.random() < 0.8, rng.random() < 0.9, rng.choice(["s", "t", None])))
            at += span
    u = spark.createDataFrame(rows, "job long, id long, start double, end double, topic string, claim long, strength double, relevance double, hook double, role string, needs array<long>, independent boolean, usable boolean, scene string").coalesce(1)
    for limits in ({"low": 8, "high": 60, "width": 5}, {"low": 8.5, "high": 30, "width": 7, "openings": 3}, {"low": 6, "high": 25, "least_candidates": 4}):
        called = spark.sparkContext.accumulator(0)
        together = D._beams
        monkeypatch.setattr(D, "_beams", lambda batch, job, bounds, *, add=called.add, **kw: (add(1), together(batch, job, bounds, **kw))[1])
        got = sorted(map(tuple, D.arrange(u, **limits).collect()))
        assert 0 < called.value < 20  # not once for each of 150 jobs
        monkeypatch.setattr(D, "_beams", lambda batch, job, bounds, **kw: (list(range(len(bounds) - 1)), {}))
        alone = sorted(map(tuple, D.arrange(u, **limits).collect()))
        monkeypatch.setattr(D, "_beams", together)
        assert got == alone and len(got) > 30


def test_reviews_take_jobs_together(spark, monkeypatch):
    """jobs are reviewed in batches; films, replacements and their order are those of one job at a time."""
    rng = random.Random(7)
    rows, said = [], []
    for job in range(200):
        at = 0.0
        for k in range(rng.randrange(5, 10)):
            span = rng.choice([1.1, 2.3, 3.7, 5.05, 26.0 if rng.random() < 0.1 else 4.0])
            rows.append((job, 3 * k, at, at + span, rng.choice(["a", "b", None]), rng.choice([rng.randrange(30), k, None]), rng.choice([0.1, 0.5, 0.7, rng.random()]), rng.choice([0.3, 0.5, 0.61, 0.9]), rng.choice([0.2, 0.5, 0.7, 0.9]), rng.choice(["x", "y", None]), [3 * rng.randrange(k + 1)] if job % 10 == 0 and k == 3 else [], rng.random() < 0.8, rng.random() < 0.9, rng.choice(["s", "t", None])))
            at += span
        said += [(job, rng.choice([0, 0, 1, 2, None]), rng.choice([None, 99, *range(0, 24, 3)]), rng.choice(["dull", "long", None])) for _ in range(rng.choice([0, 0, 1, 2, 4]))]
    u = spark.createDataFrame(rows, "job long, id long, start double, end double, topic string, claim long, strength double, relevance double, hook double, role string, needs array<long>, independent boolean, usable boolean, scene string").coalesce(1)
    remarks = spark.createDataFrame(said, "job long, attempt int, id long, reason string").coalesce(1)
    limits = {"low": 8, "high": 60}
    orders = spark.createDataFrame(D.arrange(u, width=7, **limits).collect(), "job long, candidate string, strategy string, ids array<long>, duration double, score double, selected boolean")
    result = lambda **more: sorted(map(repr, D.review_orders(u, orders, remarks, **limits, **more).collect()))
    together = D._reviews
    for rounds in (1, 3, 4):
        called, alone = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

        def counted(batch, *, calls=called.add, left=alone.add, **kw):
            out = together(batch, **kw)
            calls(1)
            left(len(out[0]))
            return out

        monkeypatch.setattr(D, "_reviews", counted)
        got = result(rounds=rounds)
        assert 0 < called.value < 20 and 0 < alone.value <= 20  # not once for each of 200 jobs; those with needs are left
        monkeypatch.setattr(D, "_reviews", lambda batch, **kw: (list(range(batch.num_rows)), {}))
        want = result(rounds=rounds)
        monkeypatch.setattr(D, "_reviews", together)
        assert got == want and len(got) > 80
    replaced = [r for r in got if "reason=" in r]
    assert sum("whole_film" in r for r in replaced) > 5 and sum("dull" in r or "long" in r for r in replaced) > 5 and sum("passed=True" in r for r in replaced) > 5


def test_whole_film_is_audited_where_it_is_arranged(spark):
    """units are read once; the violations are those of film_audit."""
    from cuelattice.plans.pipelines import whole_film

    rng = random.Random(4)
    rows = []
    for job in range(60):
        at = 0
        for k in range(rng.randrange(3, 8)):
            span = rng.randrange(1, 9)
            rows.append((job, k, at, at + span, rng.choice("ab"), rng.randrange(9), rng.choice([0.1, 0.3, 0.7]), rng.choice([0.5, 0.61, 0.9]), rng.choice([0.2, 0.5, 0.9]), "x", [], True, True, rng.choice(["s", "t", None])))
            at += span
    u = spark.createDataFrame(rows, "job long, id long, start long, end long, topic string, claim long, strength double, relevance double, hook double, role string, needs array<long>, independent boolean, usable boolean, scene string").coalesce(1)
    got = whole_film(u, low=10, high=40)
    assert got.columns == ["job", "ids", "score", "duration", "violations"] and got.schema["duration"].dataType.simpleString() == "bigint"
    assert got._jdf.queryExecution().toString().count("Scan") == u._jdf.queryExecution().toString().count("Scan")
    best = D.arrange(u, low=10, high=40).where("selected")
    film = best.selectExpr("job", "posexplode(ids) as (pos, id)").join(u, ["job", "id"])
    want = {r.job: r["count"] for r in V.film_audit(film, film.selectExpr("job", "pos", "explode(needs) as need"), low=10, high=40).groupBy("job").count().collect()}
    rows = got.collect()
    assert len(rows) > 20 and want and {r.job: r.violations for r in rows if r.violations} == want


@pytest.mark.parametrize("least", [0.6, 0.9, 0.92])
def test_leaders_are_those_of_plain_comparison(least):
    """F4, F8: every pair compared in full gives the same leaders."""
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzéñ"

    def near(key, share):
        return "".join(rng.choice(letters) if rng.random() < share else "" if rng.random() < share else c for c in key) or "a"

    for size in (5, 30, 120, 260, 400):
        base = ["".join(rng.choices(letters, weights=[1 / (k + 1) for k in range(28)], k=rng.randrange(size // 2, size + 1))) for _ in range(6)]
        keys = [near(rng.choice(base), rng.choice([0, 0.01, 0.04, 0.06, 0.09, 0.2])) for _ in range(40)]
        plain, want = [], []
        for k in keys:
            at = next((i for i, o in enumerate(plain) if k == o or D.ratio(k, o) >= least), len(plain))
            plain += [k] * (at == len(plain))
            want.append(at)
        found = D.Leaders(least)
        assert [found.place(k)[0] for k in keys] == want and found.keys == plain


def test_leaders_compare_few_pairs_in_full(monkeypatch):
    """F4, F8: unlike texts of one language aren't compared in full."""
    rng, calls = random.Random(3), []
    monkeypatch.setattr(D, "ratio", lambda a, b: calls.append(1) or 0.0)
    syllables = ["".join(rng.choices("aeioucdnrst", k=3)) for _ in range(60)]
    found = D.Leaders(0.9)
    for _ in range(400):
        found.place("".join(rng.choices(syllables, k=150)))
    assert len(found.keys) == 400 and len(calls) < 400


def test_search_aligns_once(monkeypatch):
    """many places begin with the text's first letter; one pass tells which of them to align."""
    calls, whole = [], D.longest_common
    monkeypatch.setattr(P, "longest_common", lambda a, b: calls.append(1) or whole(a, b))
    chars = [{"s": k / 10, "e": (k + 1) / 10, "ch": c} for k, c in enumerate("abcdefg" + "abacabadabacabad" * 4)]
    m = P.search(chars, "abcdefg", 5.0, (0.0, 9.0), 9.0)
    assert (m.share, m.start, m.whole, len(calls)) == (1.0, 0.0, True, 1)
    assert P.search(chars, "xyz", 5.0, (0.0, 9.0), 9.0) is None
