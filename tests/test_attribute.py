"""Attribution of items to memories against a plain version, also for scripts without blanks."""

import random
import re

from tessera.operators import attribute

UNSPACED = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯฀-๿]")


def plain(items, memories, most):
    taken, groups = set(), []
    for item in items:
        needle = (item or "").lower().strip()
        if not needle:
            continue
        pattern = re.compile(rf"(?<!\w){re.escape(needle)}(?!\w)")
        own = [r for r, (t, _) in enumerate(memories) if r not in taken and pattern.search((t or "").lower())]
        if not own and UNSPACED.search(needle):
            own = [r for r, (t, _) in enumerate(memories) if r not in taken and needle in (t or "").lower()]
        taken |= set(own)
        groups.append(own)
    order = [g[i] for i in range(max(map(len, groups), default=0)) for g in groups if i < len(g)]
    order += [r for r in range(len(memories)) if r not in taken]
    return list(dict.fromkeys(memories[r][1] for r in order if memories[r][1]))[:most]


CASES = [
    (["Ann", "new york", "c++", " Ann "], [("annual report", "a"), ("I saw Ann in New York", "b"), ("new york, c++ and ANN", "c"), ("New Yorker", "d"), (None, "e")]),
    (["東京", "京", "東京 tower"], [("私は東京に行く", "a"), ("京都", "b"), ("東京", "c"), ("東京 tower!", "d")]),
    (["京都", "東京", "京"], [("東京京都", "a"), ("東京", "b"), ("京", "c"), ("京都", "")]),
    ([r"a\Eb", "++", "-x", "x_1"], [(r"say a\Eb now", "a"), ("i ++ j", "b"), ("1 -x", "c"), ("x_12 x_1", "d"), ("c++d", "e")]),
    ([], [("t", "a"), ("u", "a"), ("v", None)]),
    (["", None, "zzz"], [("t", "a")]),
]


def test_attribution_equals_plain_matching(spark):
    rnd = random.Random(4)
    vocabulary = ["ann", "annual", "東京", "京都", "東", "new", "york", "c++", "New York", "été"]
    cases = CASES + [([rnd.choice(vocabulary) for _ in range(rnd.randint(0, 5))], [(rnd.choice(["", " "]).join(rnd.choices(vocabulary, k=rnd.randint(0, 6))), rnd.choice("pqrs")) for _ in range(rnd.randint(1, 8))]) for _ in range(60)]
    items = spark.createDataFrame([(q, p, i) for q, (its, _) in enumerate(cases) for p, i in enumerate(its)], "query_id int, place int, item string")
    memories = spark.createDataFrame([(q, r, t, s) for q, (_, ms) in enumerate(cases) for r, (t, s) in enumerate(ms)], "query_id int, rank int, text string, source string")
    got = {}
    for r in attribute.attribute(items, memories, 5).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.source)
    assert got == {q: w for q, (its, ms) in enumerate(cases) if (w := plain(its, ms, 5))}


def test_items_meet_memories_by_key(spark):
    items = spark.createDataFrame([(0, i, f"word{i} common") for i in range(50)], "query_id int, place int, item string")
    memories = spark.createDataFrame([(0, i, f"here is word{i} common") for i in range(50)], "query_id int, rank int, text string")
    plan = attribute.matches(items, memories)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert sorted((r.place, r.rank) for r in attribute.matches(items, memories).collect()) == [(i, i) for i in range(50)]
