"""Keys with a third of all rows: cool-down by pieces of time, clusters in rounds, against the plain walk."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from juristream.operators import claims
from juristream.streaming import events as stream

START = datetime.datetime(2024, 1, 1)


def fired(rows, hours):
    last, out = {}, set()
    for who, ts, event in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if who not in last or ts >= last[who] + datetime.timedelta(hours=hours):
            last[who] = ts
            out.add((who, event))
    return out


@pytest.mark.parametrize("gap", [1, 40, 4000])
def test_cooldown_spread(spark, gap):
    rng = random.Random(gap)
    rows = [(1 if i % 3 == 0 else rng.choice([None, 2, 3, 4, 5]), START + datetime.timedelta(minutes=rng.randrange(gap * 1500)), i) for i in range(1500)]
    rows += [(1, START + datetime.timedelta(minutes=7), 5000 + i) for i in range(50)]  # one moment
    df = spark.createDataFrame([(w, t, e, "x") for w, t, e in rows] + [(1, None, 9999, "x")], "user_id int, ts timestamp, event_id long, _n string")
    for hours in (1, 12):
        want = fired(rows, hours)
        assert {tuple(r) for r in stream.cooldown(df, ["user_id"], hours=hours).collect()} == want
        assert {tuple(r) for r in stream.cooldown(df, ["user_id"], hours=hours, hot_rows=100, piece_rows=40).collect()} == want


def test_pieces_are_bounded(spark):
    """A key with a third of the moments is cut into pieces of about the size asked for, whatever the moments' density."""
    moments = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(2 + F.col("id") % 40).alias("_key"), (F.col("id") * F.col("id")).alias("_at"), F.col("id").alias("event_id"), F.lit(3000).alias("_n"))
    cuts = stream.pieces(moments, 250)
    sizes = moments.join(cuts, "_key").groupBy("_key", F.size(F.filter("_bounds", lambda x: x <= F.col("_at"))).alias("p")).count()
    assert sizes.agg(F.max("count")).first()[0] <= 2 * 250
    assert stream.following(moments, 1000, 250).count() == 9000


def walked(rows):
    """As the walk decides: claims of one group in order, (id, founder, similarity)."""
    f, out = claims.Founders(), {}
    for i, text in rows:
        out[i] = f.place(text)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_in_rounds(spark, seed):
    rng = random.Random(seed)
    words = ["từ" + chr(97 + i) for i in range(25)]
    bases = [[rng.choice(words) for _ in range(rng.randint(4, 9))] for _ in range(25)]
    rows = []
    for i in range(400):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((f"y{i:04d}", "t1" if i % 3 else f"t{i % 7}", "a", " ".join(w), START + datetime.timedelta(minutes=rng.randrange(100)), "mau_thuan", 0.9))
    df = spark.createDataFrame(rows, "ykien_id string, topic string, legal_anchor_id string, claim_text string, created_at timestamp, nli_label string, nli_score double")
    key = lambda d: sorted((r["ykien_id"], r["misconception_id"], r["similarity"], r["created"]) for r in d.collect())
    want = key(claims.cluster_claims(df))
    assert key(claims.cluster_claims(df, batch=8, most=16)) == want
    # The walk itself, group by group, each distinct claim once.
    group = {}
    for i, topic, _, text, at, *_ in sorted(rows, key=lambda r: (r[4], r[0])):
        group.setdefault(topic, {}).setdefault(text, []).append(i)
    plain = {}
    for topic, texts in group.items():
        for text, (_, similarity) in walked((t, t) for t in texts).items():
            for i in texts[text]:
                plain[i] = similarity
    assert {i: s for i, _, s, _ in want} == plain
