import math
import random
import re
from itertools import combinations

from helpers import DOCS, docs_of, words
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gradeframe.llm import line_dedup as L

BETWEEN = re.compile("[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\xbf -⁯　-〿]+")


def norm(line):
    return BETWEEN.sub(" ", line.lower()).strip(" ")


def edit_distance(a, b, most=None):
    """Levenshtein distance; some larger number once it is over ``most``."""
    while a and b and a[0] == b[0]:
        same = 1
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        a, b = a[same:], b[same:]
    same = 0
    while same < min(len(a), len(b)) and a[-1 - same] == b[-1 - same]:
        same += 1
    a, b = a[: len(a) - same], b[: len(b) - same]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if most is not None and min(row) > most:
            return most + 1
    return row[-1]


def groups_of(lines, similarity=L.SIMILARITY):
    """The smallest line that each line is connected to, by edit similarity of all pairs and nothing else."""
    root = {l: l for l in lines}

    def top(l):
        while root[l] != l:
            l = root[l]
        return l

    for a, b in combinations(sorted(lines), 2):
        most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
        if top(a) != top(b) and abs(len(a) - len(b)) <= most and edit_distance(a, b, most) <= most:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return {l: top(l) for l in lines}


def lines_in(rows):
    return {norm(l) for _, t in rows if t is not None for l in t.split("\n")} - {""}


def restated(rows, top):
    """Texts left when one occurrence of each group stays."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: r[0]):
        if t is None:
            out.append((i, None, 0, 0))
            continue
        kept = []
        for l in t.split("\n"):
            n = norm(l)
            if n and top[n] in seen:
                continue
            if n:
                seen.add(top[n])
            kept.append(l)
        many = len(t.split("\n"))
        out.append((i, "\n".join(kept), many, many - len(kept)))
    return out


def found(docs, **options):
    rows = L.dedup_lines(docs, **options).select("doc_id", "text", "n_lines", "n_removed").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_fingerprints_are_majorities(spark):
    rng = random.Random(4)
    lists = [[], [5], [1, 2], [1, 3, 7]] + [[rng.getrandbits(64) - (1 << 63) for _ in range(rng.randrange(1, 60))] for _ in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, h array<bigint>")
    got = {r.i: r.fp for r in df.select("i", L.simhash(F.col("h")).alias("fp")).collect()}
    for i, own in enumerate(lists):
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))
        assert got[i] & (1 << 64) - 1 == want


def varied(seed, count=60):
    """Documents of lines that repeat, exactly and with small changes, in chains."""
    rng = random.Random(seed)
    pool = [words(rng.randrange(3, 60), seed * 50 + k, 300) for k in range(12)]
    rows = []
    for i in range(count):
        lines = []
        for _ in range(rng.randrange(0, 5)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                line[rng.randrange(len(line))] = f"w{rng.randrange(300)}"
            if rng.random() < 0.3:
                pool.append(line)  # changes of changes
            lines.append(rng.choice([" ", ", "]).join(line))
            if rng.random() < 0.2:
                lines.append(rng.choice(["", " -- ", "\t"]))
        rows.append((i, "\n".join(lines)))
    return rows


def check_against(rows, got, least=0.9):
    """Nothing is removed that edit similarity does not allow, and nearly all that it does."""
    top = groups_of(lines_in(rows))
    want = {r[0]: r for r in restated(rows, top)}
    texts = dict(rows)
    # a line goes only where another of its group stays
    left = {top[norm(l)] for _, t, _, _ in got if t is not None for l in t.split("\n") if norm(l)}
    assert left == set(top.values())
    for i, text, n_lines, n_removed in got:
        assert n_lines == want[i][2]
        if text is not None and n_removed < n_lines:
            assert len(text.split("\n")) == n_lines - n_removed
            rest = iter(texts[i].split("\n"))
            assert all(l in rest for l in text.split("\n"))  # in order
    removed, wanted = sum(r[3] for r in got), sum(r[3] for r in want.values())
    assert least * wanted <= removed <= wanted
    return removed, wanted


def test_random_lines_against_edit_similarity_alone(spark):
    for seed in (1, 2):
        rows = varied(seed, 40)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        removed, _ = check_against(rows, found(docs), 0.85)
        assert removed > 20


def test_query_against_edit_similarity_alone(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 20 and length(text) < 3000").cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_against(rows, found(docs))
    whole = entry.queries()["op8_line_dedup"](spark, data)
    assert whole.count() == spark.read.parquet(f"{data}/documents.parquet").count()


def meeting(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    both = df.select(F.arrays_overlap(L.buckets_of(F.col("a")), L.buckets_of(F.col("b"))).alias("m"))
    return [bool(r.m) for r in both.collect()]


def test_alike_lines_meet(spark):
    """Recall of the buckets over changed words, letters and both, for lines of all lengths."""
    rng = random.Random(8)
    for least, most, share in ((4, 12, 0.85), (12, 30, 0.85), (30, 80, 0.95), (80, 160, 0.95)):
        pairs = []
        while len(pairs) < 120:
            line = words(rng.randrange(least, most), rng.random(), 3000)
            other, size = list(line), len(" ".join(line))
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                at = rng.randrange(len(other))
                kind = rng.randrange(4)
                if kind == 0:
                    other[at] = f"w{rng.randrange(3000)}"
                elif kind == 1:
                    other.insert(at, f"w{rng.randrange(3000)}")
                elif kind == 2 and len(other) > 3:
                    del other[at]
                else:
                    other[at] = other[at][:-1] + "x"
            a, b = " ".join(line), " ".join(other)
            allowed = int(0.1 * max(len(a), len(b)) + 1e-9)
            if a != b and size >= 24 and edit_distance(a, b, allowed) <= allowed:
                pairs.append((a, b))
        hits = meeting(spark, pairs)
        assert sum(hits) >= share * len(hits), (least, sum(hits) / len(hits))


def test_lines_without_spaces_and_other_lines(spark):
    long = "".join(chr(0x4E00 + i * 7 % 900) for i in range(60))
    alike = [(long, long[:50] + "中" + long[50:]), (long, long[:3] + long[4:]), ("9" * 20 + "1" * 30, "9" * 20 + "1" * 31)]
    assert meeting(spark, alike) == [True] * 3
    other = [(long, long[::-1]), ("the cat of it", "the cat of us"), ("a b c d e f g", "a b c d e f h")]
    assert meeting(spark, other) == [False] * 3
    rows = [(1, f"{long}\n{long[:50]}中{long[50:]}"), (2, long + "。")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == [(1, long, 2, 1), (2, "", 1, 1)]


def test_large_groups_and_long_lines(spark):
    """Many lines that differ in one word, equal lines by the hundred, and a line of two thousand words."""
    body = words(14, 1)
    rows = [(i, " ".join([*body[:7], f"x{i % 90}", *body[7:]])) for i in range(400)]
    long = " ".join(words(2_000, 2, 50_000))
    rows += [(1000, long), (1001, long + " end"), (1002, "start " + long)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r[0], r[3]) for r in got) == [(0, 0), *((i, 1) for i in range(1, 400)), (1000, 0), (1001, 1), (1002, 1)]


def test_intermediate_tables_go(spark, tmp_path):
    import os

    from gradeframe.session import shared_dir

    def tables():
        return set(os.listdir(f"{shared_dir(spark)}/gradeframe"))

    before = tables() if os.path.isdir(f"{shared_dir(spark)}/gradeframe") else set()
    rows = varied(3)
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    left = {name.rpartition("-")[0] for name in tables() - before}
    assert left == {"lines", "repeated-lines"}
    assert out.count() == len(rows)


def test_edit_distance_without_common_ends(spark):
    rng = random.Random(6)
    pairs = [("", ""), ("a", ""), ("abc", "abc"), ("aaaa", "aa"), ("éé中x", "éé中yx"), ("x" * 5000 + "q", "x" * 5000 + "p")]
    for _ in range(150):
        a = "".join(rng.choice("ab中") for _ in range(rng.randrange(30)))
        b = list(a)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.choice("ab中")] * rng.randrange(2)
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame([(a, b, i % 5) for i, (a, b) in enumerate(pairs)], "a string, b string, most int")
    got = [r.d for r in df.select(L.edit_distance(F.col("a"), F.col("b"), F.col("most")).alias("d")).collect()]
    want = [d if d <= i % 5 else -1 for i, d in enumerate(edit_distance(a, b) if len(a) < 99 else 1 for a, b in pairs)]
    assert got == want


def test_edge_cases(spark):
    line = "One line that stands in many texts"
    rows = [(5, f"{line}\n{line}"), (5, f"{line}\n{line}"), (4, line.upper() + "!"), (None, f"x y\n{line}"), (6, None)]
    rows += [(7, ""), (8, "\n\n--\n"), (9, "x, Y\nnew")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.selectExpr("*", "1 as pos", "2 as key", "3 as n_lines", "4 as _gone", "5 as fp", "6 as text_key")
    out = L.dedup_lines(docs)
    assert set(out.columns) == set(docs.columns) | {"n_removed"}
    assert out.where("pos = 1 and key = 2 and _gone = 4 and fp = 5 and text_key = 6").count() == len(rows)
    assert found(docs) == sorted(
        [
            (5, "", 2, 2), (5, "", 2, 2), (4, "", 1, 1), (None, f"x y\n{line}", 2, 0), (6, None, 0, 0), (7, "", 1, 0),
            (8, "\n\n--\n", 4, 0), (9, "new", 2, 1),
        ],
        key=str,
    )
    assert L.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_main_path_runs_no_python(spark, data, capsys):
    from conftest import plan_of

    plan = plan_of(entry.queries()["op8_line_dedup"](spark, data), capsys)
    assert "Python" not in plan and "Pandas" not in plan and "Nested" not in plan and "Cartesian" not in plan


def scattered(line, rng, share=0.1):
    """As many letters changed as the similarity allows, over the whole line, so that hardly a word stays."""
    out, most = list(line), int(share * len(line))
    for k in range(most):
        out[k * len(line) // most + rng.randrange(2)] = rng.choice("0123456789")
    return "".join(out).strip(" ")


def test_alike_lines_without_a_common_bucket(spark):
    rng = random.Random(12)
    lines = [norm(" ".join(words(n, n, 3000))) for n in (2, 3, 4, 6, 9, 15, 30, 60, 110, 140, 400)]
    lines += ["".join(chr(0x4E00 + rng.randrange(500)) for _ in range(n)) for n in (12, 45, 300, 700)]
    pairs = [(l, scattered(l, rng)) for l in lines]
    pairs = [(a, b) for a, b in pairs if a != b and edit_distance(a, b) <= int(0.1 * max(len(a), len(b)) + 1e-9)]
    assert len(pairs) >= 13 and not all(meeting(spark, pairs))
    rows = [(i, text) for i, text in enumerate(t for pair in pairs for t in pair)]
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: r[3] for r in got} == {i: i % 2 for i in range(len(rows))}


def test_removed_lines_are_those_of_all_pairs(spark, data):
    """Exactly the lines that edit similarity of all pairs and nothing else removes."""
    rows = varied(5, 40)
    rng = random.Random(13)
    rows += [(100 + i, "\n".join(scattered(norm(l), rng) for l in t.split("\n"))) for i, t in rows[:15]]
    for similarity in (0.9, 0.7):
        want = restated(rows, groups_of(lines_in(rows), similarity))
        got = found(spark.createDataFrame(rows, "doc_id long, text string"), similarity=similarity)
        assert [(r[0], r[2], r[3]) for r in sorted(got)] == [(r[0], r[2], r[3]) for r in want]
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 60 and length(text) < 3000").cache()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    removed, wanted = check_against(rows, found(docs))
    assert removed == wanted


def test_pairs_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ROWS", 7)
    rows = varied(6, 30)
    want = restated(rows, groups_of(lines_in(rows)))
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [(r[0], r[3]) for r in sorted(got)] == [(r[0], r[3]) for r in want]


def test_cells_outnumber_edits():
    """A line in a band of cells has more of them than edits allowed, and lines below are short ones."""
    for similarity in (0.89, 0.9, 0.92, 0.95, 0.99):
        step, first, seeds = L._step(similarity), L._first_band(similarity), L._seeds(similarity)
        for n in range(2, 5000):
            band = math.floor(math.log(n) / step)
            for own in (band, band - 1):
                if own >= first:
                    least = math.ceil(math.exp(own * step) - 1e-6)
                    cell = next(s.letters for s in seeds if least >= s.from_size)
                    assert n // cell > math.floor((1 - similarity) * n + 1e-9)
    assert not L._seeds(0.85)


def test_cells_find_the_pairs_that_edit_similarity_allows(spark):
    """Edits at the start, at the end, at equal distances, in a heap and mixed; cells alone, against edit similarity."""
    rng = random.Random(21)

    def edited(line, where):
        out = list(line)
        for at in sorted(where, reverse=True):
            kind = rng.randrange(3)
            out[at : at + (kind != 0)] = [rng.choice("xyz0")] * (kind != 2)
        return "".join(out)

    lines = []
    for n in (28, 30, 39, 40, 55, 89, 90, 91, 150, 299, 300):
        line = "".join(rng.choice("aeinrst ") for _ in range(n))
        most = n // 10
        places = [range(most), range(n - most, n), range(4, n, 10), range(9, n, 10), range(n // 2, n // 2 + most)]
        places += [sorted(rng.sample(range(n), most)) for _ in range(6)]
        lines += [line, *(edited(line, list(p)[:most]) for p in places)]
    rows = [(i, len(l), i, l) for i, l in enumerate(lines)]
    df = spark.createDataFrame(rows, "key long, size int, part long, norm string")
    with L.setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        got = {(r.left, r.right) for r in L._by_cells(df, 0.9).collect()}
    first = L._first_band(0.9) * L._step(0.9)
    want = set()
    for (i, a), (k, b) in combinations(enumerate(lines), 2):
        most = max(len(a), len(b)) // 10
        if abs(len(a) - len(b)) <= most and math.log(min(len(a), len(b))) >= first and edit_distance(a, b, most) <= most:
            want.add((i, k))
    assert len(want) > 100 and want <= got


def test_pieces_stay_where_they_were_dealt(spark, tmp_path, capsys):
    """Lines are shuffled as pieces, cells and places are not; far fewer pairs than those of about a length are left."""
    from conftest import plan_of

    rows = [(i, 300, i, " ".join(words(60, i, 3000))[:300]) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, size int, part long, norm string")
    with L.setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        found = L._by_cells(df, 0.9)
        plan = plan_of(found, capsys)
        assert found.count() < 40
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.count("ENSURE_REQUIREMENTS") == 1
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_more_cells_are_shared_by_more_tasks(spark, monkeypatch, capsys):
    from conftest import plan_of

    rows = [(i, 300, i, " ".join(words(60, i // 2, 3000))[: 300 - i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, size int, part long, norm string")
    with L.setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        whole = sorted(map(tuple, L._by_cells(df, 0.9).collect()))
        monkeypatch.setattr(L, "TASK_CELLS", 1000)
        dealt = L._by_cells(df, 0.9)
        assert sorted(map(tuple, dealt.collect())) == whole
        assert "place#" in (plan := plan_of(dealt, capsys)) and ", 14), REPARTITION_BY_NUM" in plan
    assert {(i, i + 1) for i in range(0, 200, 2)} <= set(whole)


def test_pieces_of_lines_meet_in_passes(spark, monkeypatch):
    """Each pass shuffles a part of the pieces only, so less than all pieces are on disk at a time."""
    lines = [" ".join(words(80, i // 2, 3000))[: 40 + i // 2 % 300 - i % 2] for i in range(600)]
    df = spark.createDataFrame([(i, len(l), i, l) for i, l in enumerate(lines)], "key long, size int, part long, norm string")
    passes = []

    def counted(table, label, written=L.written):
        if label == "pairs-of-pass":
            passes.append(table)
        return written(table, label)

    monkeypatch.setattr(L, "written", counted)
    with L.setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        whole = sorted(map(tuple, L._by_cells(df, 0.9).collect()))
        assert not passes
        monkeypatch.setattr(L, "PASS_LETTERS", 1000)
        assert sorted(map(tuple, L._by_cells(df, 0.9).collect())) == whole
    assert len(passes) == 2 * L.PASSES and len(whole) > 250
    found = [p.count() for p in passes]
    assert max(found) < len(whole) / 2


def test_tables_of_buckets_are_gone_before_cells_meet(spark, monkeypatch):
    from gradeframe.llm import storage

    there = []

    def alike(docs, groups, similarity, all_alike=L.all_alike):
        there.extend(path.rpartition("/")[2].rpartition("-")[0] for _, path in storage._WRITTEN)
        return all_alike(docs, groups, similarity)

    before = len(storage._WRITTEN)
    monkeypatch.setattr(L, "all_alike", alike)
    line = " ".join(words(40, 1, 3000))
    docs = docs_of(spark, [line, line + " x"])
    assert L.dedup_lines(docs).selectExpr("sum(n_removed)").first()[0] == 1
    assert set(there[before:]) == {"lines", "line-classes", "line-links", "line-groups"}


def test_rows_of_buckets_are_those_of_each_line(spark, monkeypatch):
    """Words that are counted as rows make the buckets that a line makes of its own list, for lines of all lengths."""
    rng = random.Random(31)
    sizes = [1, 2, 5, 6, 11, 12, 13, 18, 23, 24, 25, 40, 66, 90, 150, 300, 700]
    lines = [" ".join(words(n, rng.random(), 4000)) for n in sizes] + ["a b " * 40 + "c", "中" * 50, "x " * 30]
    df = spark.createDataFrame([(i, len(l), l) for i, l in enumerate(lines)], "key long, size int, norm string")
    want = {tuple(r) for r in df.select("key", "size", F.explode(L.buckets_of(F.col("norm")))).collect()}
    assert {tuple(r) for r in L.bucket_rows(df).collect()} == want
    monkeypatch.setattr(L, "MOST_WORDS", 100)
    assert {tuple(r) for r in L.bucket_rows(df).collect()} == want


def test_cells_of_letters_of_four_bytes(spark):
    """Letters of one to four bytes take the same place; the pairs are those of edit similarity at least."""
    rng = random.Random(32)
    lines = []
    for n in (40, 95, 130, 400):
        line = "".join(rng.choice("aeinrst é中𠀀𠀁😀") for _ in range(n)).strip()
        for at in (0, n // 2, n - 3):
            lines.append(line[:at] + "𠀂" + line[at + 1 :])
    df = spark.createDataFrame([(i, len(l), i, l) for i, l in enumerate(lines)], "key long, size int, part long, norm string")
    with L.setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        got = {(r.left, r.right) for r in L._by_cells(df, 0.9).collect()}
    want = {(i, k) for i, k in combinations(range(len(lines)), 2) if edit_distance(lines[i], lines[k]) <= len(lines[k]) // 10}
    assert len(want) >= 12 and want <= got


def test_chance_cells_are_no_pairs(spark):
    """Lines that share every cell of nine letters with others, but not what follows it, are left before texts are read."""
    rng = random.Random(33)
    cells = ["".join(rng.choice("aeinrst") for _ in range(9)) for _ in range(12)]
    lines = ["".join(rng.choice(cells) for _ in range(20)) for _ in range(150)]
    df = spark.createDataFrame([(i, len(l), i, l) for i, l in enumerate(lines)], "key long, size int, part long, norm string")
    with L.setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        assert L._by_cells(df, 0.9).count() < 3000  # of 11,175


def test_cells_of_a_place_are_dealt_by_hash(spark, monkeypatch, capsys):
    """A band whose cells are too many for one task's memory is met in blocks; cells of one hash stay together."""
    from conftest import plan_of

    lines = [" ".join(words(80, i // 2, 3000))[: 300 - i % 2] for i in range(120)]
    df = spark.createDataFrame([(i, len(l), i, l) for i, l in enumerate(lines)], "key long, size int, part long, norm string")
    with L.setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        whole = sorted(map(tuple, L._by_cells(df, 0.9).collect()))
        monkeypatch.setattr(L, "BLOCK_ROWS", 50)
        monkeypatch.setattr(L, "BLOCK_CELLS", 5)
        found = L._by_cells(df, 0.9)
        assert sorted(map(tuple, found.collect())) == whole and len(whole) >= 60
        assert "pmod(hash(" in plan_of(found, capsys)


def test_long_lines_of_few_and_many_edits(spark):
    rng = random.Random(34)
    line = "".join(rng.choice("abcdefgh ") for _ in range(600))
    pairs = []
    for edits in (1, 6, 7, 8, 30, 59, 60, 61, 90):
        other = list(line)
        for at in rng.sample(range(600), edits):
            other[at] = "z"
        pairs.append((line, "".join(other)))
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r.d for r in df.select(L.edit_distance(F.col("a"), F.col("b"), F.lit(60)).alias("d")).collect()]
    want = [edit_distance(a, b) for a, b in pairs]
    assert got == [d if d <= 60 else -1 for d in want] and -1 in got


def test_cells_of_a_task_fit_its_memory(spark, monkeypatch):
    """No place of a band has more cells than a quarter of what 256 MB of a hash table hold, however many its lines are."""
    assert L.BLOCK_ROWS * L.BLOCK_CELLS * 150 <= 64 << 20
    rows = [(i, 300, i, " ".join(words(60, i, 3000))[:300]) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, size int, part long, norm string")
    blocks = []

    def seen(table, label, written=L.written):
        out = written(table, label)
        if label == "line-bands":
            blocks.extend((r.blocks, r.s, r.width) for r in out.collect())
        return out

    monkeypatch.setattr(L, "written", seen)
    monkeypatch.setattr(L, "BLOCK_ROWS", 100)
    with L.setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        L._by_cells(df, 0.9)
    # 400 lines of a band with up to 25 cells of a stretch and the places around it
    assert blocks and all(b >= 400 * 20 / (100 * L.BLOCK_CELLS) for b, _, _ in blocks)
