"""Hand-computed cases of operators that SQL can't express, and of sources."""

import difflib
import io
import json
import math
import os
import random
import struct
import wave

import pytest
from pyspark.sql import functions as F

from cuelattice.functions import text as T
from cuelattice.functions.vocab import CHINESE, CHINESE_TERMS, merge_layers, read_layer
from cuelattice.operators import folds as D
from cuelattice.operators import graph as G
from cuelattice.operators import intervals as I
from cuelattice.operators import records
from cuelattice.operators import rules as R
from cuelattice.operators import select as P
from cuelattice.operators import sets as S
from cuelattice.plans import fold_queries
from cuelattice.sources import audio, sinks, subtitles, timelines, transcripts
from cuelattice.streaming import events


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def words(spark, *rows):
    return spark.createDataFrame([(1, float(s), float(e), w) for w, s, e in rows], "job long, s double, e double, w string")


def clauses(spark, *rows):
    return spark.createDataFrame([(1, k, t, float(s), float(e)) for k, (t, s, e) in enumerate(rows)], "job long, id long, text string, start double, end double")


def split(spark, rows, **kw):
    kw = {"most": 6.0, "least": 0.8, "silence": 0.3} | kw
    return D.split_clauses(words(spark, *rows), **kw).orderBy("id").collect()


def test_split_at_marks_silence_and_cap(spark):
    assert len(split(spark, [("你好", 0, 1.2), ("世界。", 1.2, 2.4), ("再来", 2.4, 3.6), ("一句。", 3.6, 4.8)])) == 2
    assert len(split(spark, [("前面", 0, 1.2), ("后面", 1.6, 2.8)])) == 2
    capped = split(spark, [("一", 0, 2), ("二", 2, 4), ("三", 4, 6), ("四", 6, 8)])
    assert len(capped) > 1 and all(r.end - r.start <= 6 for r in capped)
    assert len(split(spark, [("主句内容", 0, 2), ("短", 2.4, 3.0)], least=1.0)) == 1


def test_split_by_sentences(spark):
    s = spark.createDataFrame([(1, 0.0, 4.0)], "job long, start double, end double")
    out = D.split_clauses(words(spark, ("一二", 0, 1.5), ("三四。", 1.5, 2.0), ("五六", 2.6, 4.0)), sentences=s, most=6, least=0.8, silence=0.3).orderBy("id").collect()
    assert [r.split_from for r in out] == [0, 0]


def test_units(spark):
    n = lambda *rows: D.build_units(clauses(spark, *rows), CHINESE, grow=4, cap=8, silence=0.3).count()
    assert n(("甲", 0, 2), ("乙", 2, 4)) == 1
    assert n(("甲。", 0, 2), ("乙", 2, 4)) == 2
    assert n(("甲", 0, 2), ("乙", 2.5, 4)) == 2
    units = D.build_units(clauses(spark, ("甲因为", 0, 3.5), ("乙", 3.5, 6.5), ("丙", 6.5, 9.5)), CHINESE, grow=4, cap=8, silence=0.3).orderBy("unit").collect()
    assert [(u.first, u.last) for u in units] == [(0, 1), (2, 2)]


def test_batches(spark):
    b = lambda *sizes: [r.batch for r in D.pack_batches(spark.createDataFrame([(1, k, n) for k, n in enumerate(sizes)], "job long, unit long, n long"), most=120).orderBy("unit").collect()]
    assert b(50, 50, 50) == [0, 0, 1]
    assert b(10, 200, 10) == [0, 1, 2]


def test_rules(spark):
    rows = [("小香风", None), ("羊毛小香", "小香"), ("卖了300单", "300单")]
    df = spark.createDataFrame([(t,) for t, _ in rows], "text string").select("text", T.first_hit(F.col("text"), CHINESE.hard_pattern).alias("hit"))
    assert [(r.text, r.hit) for r in df.collect()] == rows
    cases = [("的收腰的感觉很像", "context_dependent_start"), ("删掉来整个先删掉好", "stage_chatter"), ("推荐它是因为。", "incomplete_sentence"), ("", "empty_text"), ("面料很好", None)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "text string").select(R.content_rejection(F.col("text"), CHINESE).alias("r"), R.dangling_end(F.col("text"), CHINESE).alias("e"))
    got = df.collect()
    assert [r.r for r in got] == [x for _, x in cases] and got[2].e == "因为"


def test_terms_and_numerals(spark):
    r = spark.createDataFrame([("大底T恤裸口150斤",)], "t string").select(T.replace_terms(F.col("t"), CHINESE_TERMS).alias("a"), T.numerals(F.col("t")).alias("b")).first()
    assert r.a == "大版T恤罗纹150斤" and r.b.endswith("一百五十斤")
    got = spark.createDataFrame([(n,) for n in (0, 7, 10, 19, 20, 42, 100, 105, 110, 111, 999, 1000)], "n long").select(T.numeral_text(F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == ["零", "七", "十", "十九", "二十", "四十二", "一百", "一百零五", "一百十", "一百十一", "九百九十九", "1000"]


def test_interval_map(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 4.0, 2.0, 2.0), (1, 1, 4.0, 8.0, 3.0, 1.0)], "job long, seg long, t_start double, t_end double, src double, speed double")
    ask = spark.createDataFrame([(1, 3.0, 6.0)], "job long, s double, e double")
    out = I.map_range(I.overlap_join(ask, seg, ["job"], ("s", "e"), ("t_start", "t_end"), bucket=2.0), ("s", "e"), ("t_start", "t_end"), "src", F.col("speed")).orderBy("seg").collect()
    assert [(r.source_from, r.source_to) for r in out] == [(8.0, 10.0), (3.0, 5.0)]
    assert math.isclose(sum(r.piece_end - r.piece_start for r in out), 3.0)


def test_draft(spark):
    draft = {"materials": {"videos": [{"id": "v", "path": "a.mp4"}], "speeds": []}, "tracks": [{"type": "video", "segments": [{"material_id": "v", "source_timerange": {"start": 0, "duration": 390_000_000}, "target_timerange": {"start": 0, "duration": 300_000_000}, "extra_material_refs": []}, {"material_id": "gone", "source_timerange": {"start": 0, "duration": 1}, "target_timerange": {"start": 0, "duration": 1}, "extra_material_refs": []}]}]}
    df = spark.createDataFrame([(json.dumps(draft),)], "j string").select(F.lit(1).alias("job"), F.from_json("j", timelines.DRAFT).alias("d")).select("job", "d.*")
    out = timelines.flatten_draft(df).collect()
    assert len(out) == 1 and out[0].segment_id == "seg_001" and math.isclose(out[0].speed, 1.3) and out[0].source_end == 390
    checked = timelines.checked(timelines.flatten_draft(df)).first()
    assert checked.problem is None
    native = spark.createDataFrame([(1, [("s", 0.0, 2.0, "a", 0.0, 4.0, 1.0)])], "job long, segments array<struct<segment_id:string,timeline_start:double,timeline_end:double,source_path:string,source_start:double,source_end:double,speed:double>>")
    assert timelines.flatten_native(native).first().speed == 2.0
    assert sinks.edit_decisions(timelines.flatten_draft(df), "job", "timeline_start").first().cut == 1


def test_subtitles(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,500 --> 00:00:03,000\n<b>你好</b> 世界\n\n2\n00:00:04,000 --> 00:00:04,000\n空\n", encoding="utf-8")
    (tmp_path / "b.ass").write_text("Dialogue: 0,0:00:01.00,0:00:02.50,Default,,0,0,0,,{\\an8}左\\N右, 完\n", encoding="utf-8")
    (tmp_path / "c.txt").write_text("[00:01 --> 00:02] 文本\n", encoding="utf-8")
    rows = sorted((r.path.rsplit("/", 1)[1], r.start, r.end, r.text) for r in subtitles.read_subtitles(spark, str(tmp_path)).collect())
    assert rows == [("a.srt", 1.5, 3.0, "你好世界"), ("b.ass", 1.0, 2.5, "左右,完"), ("c.txt", 1.0, 2.0, "文本")]
    assert subtitles.words_of_blocks(subtitles.read_subtitles(spark, str(tmp_path))).first().boundary_only


def test_transcripts(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps([{"s": 0, "e": 1, "w": "a"}, {"start": 1, "end": 2, "text": "b"}]))
    assert [r.w for r in transcripts.read_words(spark, str(tmp_path / "w.json")).orderBy("s").collect()] == ["a", "b"]
    (tmp_path / "none.json").write_text("[]")
    with pytest.raises(Exception, match="no words"):  # one empty file among others
        transcripts.read_words(spark, [str(tmp_path / "w.json"), str(tmp_path / "none.json")]).collect()
    rec = spark.createDataFrame([(1, [(0.0, 1.0004, " x ", [(0.0, 0.5, " "), (0.5, 1.0, "x")])])], "job long, segments array<struct<start:double,end:double,text:string,words:array<struct<start:double,end:double,word:string>>>>")
    s, w = transcripts.flatten_segments(rec, "job")
    assert s.first().end == 1.0 and w.count() == 1
    (tmp_path / "c.json").write_text("{}")
    assert transcripts.read_stage(spark, str(tmp_path / "c.json"), transcripts.CLAUSES, "clauses", strict=False).count() == 0


def test_levels(spark, tmp_path):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(1000)
        w.writeframes(struct.pack("<40h", *([0] * 20 + [300] * 20)))
    (tmp_path / "a.wav").write_bytes(out.getvalue())
    assert [round(r.level) for r in audio.read_levels(spark, str(tmp_path / "a.wav")).orderBy("frame").collect()] == [0, 300]


def test_layers(tmp_path):
    assert read_layer(str(tmp_path / "none.json")) == {}
    p = CHINESE.layered({"hard_add": ["新词"], "hard_remove": ["链接"], "review_add": ["新词", "另词"]})
    assert "新词" in p.hard and "链接" not in p.hard and "新词" not in p.review and "另词" in p.review
    assert merge_layers({"hard_add": ["a", "b"]}, {"hard_remove": ["a"], "hard_add": ["c"]})["hard_add"] == ["b", "c"]


def test_duplicates(spark):
    rows = clauses(spark, ("这件衣服面料非常舒服", 0, 2), ("这件衣服面料非常舒服啊", 2, 5), ("完全不同的一句话", 5, 6), ("", 6, 7), ("", 7, 8))
    assert [r.duplicate_of for r in D.greedy_near_duplicates(rows).orderBy("id").collect()] == [None, 0, None, None, None]
    assert [r.duplicate_of for r in D.literal_dedup(rows).orderBy("id").collect()] == [1, None, None, None, None]


def test_graph(spark):
    rows = spark.createDataFrame([(1, k) for k in range(7)], "job long, id long")
    edges = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 9), (1, 4, 5), (1, 5, 4), (1, 6, 4)], "job long, id long, need long")
    got = {r.id: r.state for r in G.dependency_states(rows, edges, "job").collect()}
    assert got == {0: "valid", 1: "valid", 2: "valid", 3: "missing", 4: "cycle", 5: "cycle", 6: "cycle"}
    asked = spark.createDataFrame([(1, 2), (1, 6)], "job long, id long")
    assert sorted(r.id for r in G.closure_of(asked, rows, edges, "job").collect()) == [0, 1, 2]
    blocks = spark.createDataFrame([(1, 0, [0, 1]), (1, 2, [1, 2]), (1, 7, [7])], "job long, root long, members array<long>")
    assert sorted((r.block, r.members) for r in G.merged_blocks(blocks, "job").collect()) == [(0, [0, 1, 2]), (7, [7])]


def test_shots_and_windows(spark):
    rows = spark.createDataFrame([(1, 0, "C001", 0.0, 4.0), (1, 1, "C001", 0.0, 4.0), (1, 2, "C003", 1.0, 3.0)], "job long, pos long, shot string, start double, end double")
    assert [r.accepted for r in D.accept_shots(rows).orderBy("pos").collect()] == [True, False, False]
    assert D.covering_window(10, 11, [(8, 10.5), (20, 21)], grid=2, pad=0.5, cap=30) == (8, 12)


def test_json_search():
    text = 'noise ```json\n{"properties": {"ids": 1}, "ids": 0}\n``` {"a": [{"ids": [1], "n": {"tokens": 3}}]}'
    assert D.find_object(text, {"ids"}) == {"ids": [1], "n": {"tokens": 3}}
    assert D.greatest_counters({"a": {"tokens": 3}, "b": [{"tokens": 7}]}, {"tokens"}) == {"tokens": 7}
    assert D.canonical_digest({"b": 1, "a": 2}) == D.canonical_digest({"a": 2, "b": 1})
    assert D.longest_common("abcd", "xbd") == [(1, 1), (3, 2)]


def test_free_names(spark):
    wanted = spark.createDataFrame([("a",), ("B",), ("c",), ("d-2",)], "t string")
    used = spark.createDataFrame([("A",), ("a-1",), ("a-3",), ("c-1",), ("b-9",), ("d-2",), ("d",)], "t string")
    assert {r.t: r.free_name for r in S.free_suffix(wanted, used, "t").collect()} == {"a": "a-2", "B": "B", "c": "c", "d-2": "d-2-1"}


def test_stream(spark, tmp_path):
    rows = spark.range(20).selectExpr("id % 10 as id", "timestamp_seconds(1700000000 + id * 600) as ts", "'k' as kind", "cast(id as double) as value")
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.tail_events(spark, str(tmp_path / "in"), "id long, ts timestamp, kind string, value double")
    q = events.write_stream(events.distinct_events(stream, late="5 hours"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10
    q = events.write_stream(events.kind_counts(stream), str(tmp_path / "out2"), str(tmp_path / "ck2"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out2")).selectExpr("sum(n)").first()[0] > 0


def test_model_boundary(spark):
    import pytest

    from cuelattice.operators import records as C

    rows = spark.createDataFrame([(1, k) for k in range(5)], "job long, id long")
    scored = C.score_batches(rows, lambda asked: [{"job": r["job"], "id": r["id"], "usable": r["id"] != 2} for r in asked] + [{"job": 1, "id": 99, "usable": True}], "job long, id long, usable boolean", size=2)
    once = scored.dropDuplicates(["job", "id"])
    assert sorted((r.id, r.usable) for r in C.checked_decisions(rows, once, "job", "id").collect()) == [(k, k != 2) for k in range(5)]
    with pytest.raises(Exception, match="missing 4"):
        C.checked_decisions(rows, once.where("id <> 4"), "job", "id").collect()
    assert C.chosen_bounds(clauses(spark, ("a", 0, 1), ("b", 2, 2))).count() == 1
    assert C.table_differences(spark, rows, rows.withColumn("x", F.lit(1))) == [("x", "- -> int")]


def test_fingerprints(spark, tmp_path):
    import hashlib

    from cuelattice.operators import records as C

    (tmp_path / "f.bin").write_bytes(b"abcdef")
    r = C.file_fingerprints(spark, str(tmp_path / "f.bin"), sample=2).first()
    assert r.digest == hashlib.sha256(b"abef").hexdigest()
    df = spark.createDataFrame([("a", None), ("a", "")], "x string, y string").select(C.cache_key(F.col("x"), F.col("y")).alias("k"))
    assert df.distinct().count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_orders_of_every_job(spark):
    """Jobs of any number get their orders, by the operator's own beam width."""
    u = fold_queries.units(spark, SF)
    asked = u.select("job", F.col("pos").alias("id"), "start", "end", "topic", (F.col("pos") % 8).alias("claim"), "strength", (0.4 + F.col("relevance") / 2).alias("relevance"), (0.5 + F.col("hook") / 2).alias("hook"), "role", F.array().cast("array<bigint>").alias("needs"), F.lit(True).alias("independent"), F.lit(True).alias("usable"))
    want = {(r.job, r.candidate): (",".join(map(str, r.ids)), r.score) for r in D.arrange(asked, low=6000, high=16_000, width=60, second=1000).collect()}
    got = fold_queries.beam_arrange(spark, SF).collect()
    assert {(r.job, r.candidate): (r.ids, r.score) for r in got} == want
    films = fold_queries.film_pipeline(spark, SF).collect()
    assert {r.job for r in films if r.job % 40} and all(r.violations >= 0 for r in films)


def test_whole_texts(spark, tmp_path):
    """Against brute force: turns that agree only in their openings, or only after them."""
    body = "one quick brown fox sees seven lazy dogs near old mill walls today while rain falls over green hills"
    opening = "we have all heard this very long opening line that never ends and goes on"
    texts = [f"{opening} {body}", f"{opening} quite other things stand here: 123 456 789 000 111 222 333", f"{opening} {body} now", f"A {body} {body}", f"Bcdefgh {body} {body}", "", f"A {body} {body}"]
    spark.createDataFrame([(50 * k, 0, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    ids = [5000 * k for k in range(len(texts))]

    def brute(key, least):
        kept, out = [], {}
        for i, t in zip(ids, map(key, texts), strict=True):
            out[i] = next((j for j, o in kept if t and o and (t == o or difflib.SequenceMatcher(None, t, o).ratio() >= least)), None)
            kept += [(i, t)] if out[i] is None else []
        return out

    near = brute(D.key_of, 0.9)
    assert {r.id: r.duplicate_of for r in fold_queries.greedy_near_dup(spark, str(tmp_path)).collect()} == near and near[ids[1]] is None and near[ids[4]] == ids[3]
    lead = {i: j if j is not None else i for i, j in brute(D.letters, 0.92).items()}
    same = {i: frozenset(j for j in ids if lead[j] == lead[i]) for i in ids}
    got = {r.id: r.duplicate_of for r in fold_queries.literal_dedup(spark, str(tmp_path)).collect()}
    best = {i: j if j is not None else i for i, j in got.items()}
    assert {i: frozenset(j for j in ids if best[j] == best[i]) for i in ids} == same
    last = {r.job: r.s for r in fold_queries.words(spark, str(tmp_path)).groupBy("job").agg(F.max("s").alias("s")).collect()}
    found = {r.job: r for r in fold_queries.lcs_align(spark, str(tmp_path)).collect()}
    assert {j: (r.coverage, r.end) for j, r in found.items()} == {j: (1.0, float(s)) for j, s in last.items()}


def test_near_repeats(spark, tmp_path):
    """Reworded repeats count as errors; each row is held against all rows before it, the first near one is named."""
    texts = ["the warm red coat keeps out wind", "the warm red coat keeps off wind", "short", "short", "something else was said in between", "the warm red coat keeps out winds"]
    spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {(r["first"], r["last"]) for r in fold_queries.text_issues(spark, str(tmp_path)).where("code = 'duplicate_text'").collect()}
    assert found == {(0, 1), (2, 3), (0, 5)}
    one = fold_queries.copy_review(spark, str(tmp_path)).collect()[0]
    parts = one.dangling_references + one.dangling_continuations + one.product_jumps + one.color_jumps
    assert one.repeated_conclusions == 2 and one.errors == parts + 2


def test_unbuilt_methods_are_not_claimed():
    assert "TOPK5" not in (fold_queries.beam_arrange.__doc__ + D.arrange.__doc__)
    assert "STR10" not in (fold_queries.lcs_align.__doc__ + D.align_texts.__doc__)


def test_merged_blocks_of_a_long_chain(spark):
    rng = random.Random(4)
    names = rng.sample(range(1000), 300)
    rows = [(1, names[k], [k, k + 1]) for k in range(300)] + [(1, 5000, [900]), (2, 7, [1, 2]), (2, 3, [2]), (2, 9, [5])]
    blocks = spark.createDataFrame(rows, "job long, root long, members array<long>")
    merged = G.merged_blocks(blocks, "job")
    got = {(r.job, r.block): r.members for r in merged.collect()}
    assert got == {(1, min(names)): list(range(301)), (1, 5000): [900], (2, 3): [1, 2], (2, 9): [5]}
    plan = spark.createDataFrame([(2, 1, 77), (2, 2, 5), (2, 3, 2), (2, 4, 5), (2, 5, 1)], "job long, pos long, id long")
    assert [(r.place, r.block, r.members) for r in G.ordered_blocks(merged, plan, "job").orderBy("place").collect()] == [(1, 9, [5]), (2, 3, [1, 2])]


def test_pair_similarity_by_either_way(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abcdef") for _ in range(30)) for _ in range(6)]
    texts = [b[:i] + "xy" + b[i + 2 :] for b in base for i in (0, 8, 20)] + ["", "ab", None, "aaaaaaaaaa", "aaaaaaaa", base[0]]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "job long, id long, t string")
    pairs = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    want = {(a, b) for b in range(len(texts)) for a in range(b) if all(texts[k] and len(texts[k]) >= 6 for k in (a, b)) and len(pairs(texts[a]) & pairs(texts[b])) >= 0.6 * len(pairs(texts[a]) | pairs(texts[b]))}
    for few in (64, 2):
        got = S.pair_similarity(rows, "job", "id", "t", least=0.6, few=few).collect()
        assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 15


def test_budgeted_digest(spark):
    rows = [(1, 0, "a", "xxxx"), (1, 1, "a", "xx"), (1, 2, "b", "x" * 9), (1, 3, "b", "xxx"), (1, 4, "other", "x"), (1, 5, "other", "x" * 9), (1, 6, "other", "x"), (1, 7, "c", "x"), (2, 0, "other", None), (2, 1, "a", "x" * 99)]
    df = spark.createDataFrame(rows, "job long, id long, category string, text string")
    take = lambda **k: sorted((r.job, r.id) for r in P.budgeted_digest(df, "job", "id", "category", ["a", "b"], **k).collect())
    # a: 4 characters, b: 9 exceed 10, a: 2 make 6, b: 3 make 9; other: 1 makes 10, the next exceeds and ends it
    assert take(most=8, most_chars=10, share=0.5) == [(1, 0), (1, 1), (1, 3), (1, 4), (2, 0)]
    assert take(most=3, share=0.25) == [(1, 0), (1, 1), (1, 2), (2, 1)]
    assert take(most=4, share=0.25) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]
    assert take(most=12, share=0.25) == [(1, k) for k in (0, 1, 2, 3, 4, 5, 6)] + [(2, 0), (2, 1)]


def test_dependency_dedup_of_long_chains(spark):
    # A chain, and a ladder whose paths can't all be walked.
    texts = [chr(0x4E00 + 20 * k) * 9 for k in range(60)]
    chain = [(1, k, texts[k], float(k), 1.0, [k + 1] if k + 1 < 60 else []) for k in range(60)]
    ladder = [(2, k, texts[k], float(k), 1.0, [j for j in (k + 1, k + 2) if j < 60]) for k in range(60)]
    broken = [(3, 0, texts[0], 0.0, 1.0, [1]), (3, 1, texts[1], 1.0, 1.0, [2]), (3, 2, texts[2], 2.0, 1.0, [1]), (3, 3, texts[3], 3.0, 1.0, [9]), (3, 4, texts[4], 4.0, 1.0, [])]
    df = spark.createDataFrame(chain + ladder + broken, "job long, id long, text string, start double, quality double, needs array<long>")
    kept = {(r.job, r.id) for r in D.dependency_dedup(df).collect()}
    assert kept == {(j, k) for j in (1, 2) for k in range(60)} | {(3, 4)}


def test_drop_repairs(spark):
    plan = spark.createDataFrame([(j, k, 10.0 * k, 10.0 * k + 10, [k - 1] if k == 2 else []) for j in (1, 2, 3, 4, 5) for k in range(4)], "job long, id long, start double, end double, needs array<long>")
    issues = spark.createDataFrame([(1, [0], "drop"), (1, [0], "drop"), (2, [1], "drop"), (3, [0], "drop"), (3, [3], "replace"), (4, [0, 3], "drop"), (6, [0], "drop")], "job long, ids array<long>, action string")
    out = records.drop_repairs(plan, issues, low=25, high=40).collect()
    assert {r.job: r.repair for r in out} == {1: "delete_only", 2: "compose", 3: "compose", 4: "compose", 5: None}  # 2 needs 1; 3 says replace; 4 gets too short
    assert {(r.job, r.id) for r in out if r.excluded} == {(1, 0), (2, 1), (3, 0), (3, 3), (4, 0), (4, 3)} and len(out) == 20


def test_reuse_or_compute(spark):
    inputs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "job long, digest string")
    stored = spark.createDataFrame([(1, "a", "old"), (1, "a", "old2"), (2, "x", "stale"), (9, "z", "gone"), (4, None, "no")], "job long, digest string, value string")
    out = records.reuse_or_compute(inputs, stored, lambda todo: todo.withColumn("value", F.lit("new")))
    assert sorted((r.job, r.value) for r in out.collect()) == [(1, "old"), (1, "old2"), (2, "new"), (3, "new"), (4, "new")]


def test_report_path(spark):
    steps = ["validate", "qc_body", "validate_video_mapping_body", "validate_video_mapping_hook_A", "qc_hook_b%s", "other", None]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(steps)], "k long, step string")
    paths = [r.p for r in df.select("k", records.report_path(F.col("step")).alias("p")).orderBy("k").collect()]
    assert paths == ["validation.json", "qc/body/qc_report.json", "dual_body_report.json", "dual_hook_A_report.json", "qc/hook_b%s/qc_report.json", None, None]


def test_coarse_filter_query_has_the_rules_of_its_sql(spark, tmp_path):
    """a text of repeated characters is no reason in the query's SQL; the operator keeps the rule."""
    import duckdb
    from cuelattice.plans import catalog

    rows = [(1, 0, "u", "key 00000000 ok"), (1, 1, "u", "key 00000000 ok"), (1, 2, "u", "..."), (1, 3, "u", "eur zzzzzzzzz"), (2, 0, "u", "a plain one")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(f"SELECT job, id, filter_reason FROM ({catalog.ORACLES['coarse_filter_last_wins']})").fetchall()
    got = catalog.QUERIES["coarse_filter_last_wins"](spark, str(tmp_path)).select("job", "id", "filter_reason")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    kept = R.coarse_filter(spark.createDataFrame([(1, 0, "key 00000000 ok")], "job long, id long, text string"), invalid="x{9}", other="(x{9})")
    assert kept.first().filter_reason == "obvious_asr_repetition"
