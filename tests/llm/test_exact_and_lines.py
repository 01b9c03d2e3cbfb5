import pytest

from sparrel.llm.exact_dedup import GraceTable, exact_dedup
from sparrel.llm.line_dedup import drop_repeated_lines, keep_bitmaps

DOCS = "doc_id long, text string, kept string, n int"


def test_copies(spark):
    rows = [(5, "a  b", "x", 1), (3, "a\tb", None, 2), (9, None, "y", 3), (8, "", "z", 4), (1, "c", "", 5), (None, "c", "", 6), (1, "c", "", 5), (7, "a b ", "", 0)]
    got = sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept, r.n) for r in exact_dedup(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(-1, 1, 3, False, 6), (1, 1, 3, True, 5), (1, 1, 3, True, 5), (3, 3, 2, True, 2), (5, 3, 2, False, 1), (7, 7, 1, True, 0), (8, 8, 2, True, 4), (9, 8, 2, False, 3)]
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
    odd = spark.createDataFrame([(2, "a", "mine", 7, "s", "d")] * 2 + [(1, "a", None, 8, "t", "e")], "doc_id long, text string, _own string, _n int, smallest string, `a.b` string")
    got = exact_dedup(odd)
    assert got.columns == ["doc_id", "text", "_own", "_n", "smallest", "a.b", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r[0], r[2], r[3], r[5], r[6]) for r in got.collect()) == [(1, None, 8, "e", 1), (2, "mine", 7, "d", 1), (2, "mine", 7, "d", 1)]


def test_long_texts_and_spills(spark):
    rows = [(n, "word " * 200_000 + str(n % 3), "", 0) for n in range(9)]
    got = exact_dedup(spark.createDataFrame(rows, DOCS).coalesce(1), budget=1 << 16)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == [(n, n % 3, 3) for n in range(9)]


@pytest.mark.parametrize("budget", [10, 5_000, 1 << 20])
def test_grace_table_against_dict(tmp_path, budget):
    table, want = GraceTable(budget, str(tmp_path / "s")), {}
    for n in range(3000):
        content = str(n * n % 701).encode() * (1 + n % 3 * 0)
        # few hashes, so that equal hashes with different contents meet
        table.add(hash(content) % 97, content, 5000 - n, 1)
        least, count = want.get(content, (9999, 0))
        want[content] = (min(least, 5000 - n), count + 1)
    got = {c: (i, n) for _, c, i, n in table.groups()}
    assert got == want
    table.close()
    assert not (tmp_path / "s").exists()


def brute_lines(rows, min_docs, keep_first):
    import string

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))

    homes, seen, out = {}, set(), []
    for doc, text in sorted(rows):
        for line in (text or "").split("\n"):
            homes.setdefault(key(line), set()).add(doc)
    for doc, text in sorted(rows):
        kept = []
        lines = (text or "").split("\n")
        for line in lines:
            k = key(line)
            gone = k and len(homes[k]) >= min_docs and not (keep_first and k not in seen)
            seen.add(k)
            if not gone:
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("keep_first", [True, False])
def test_lines_against_brute_force(spark, keep_first):
    rows = [(n, "\n".join(["Head ", f"own {n}", " head", "", "\tÉ" if n % 2 else "é", f"pair {n // 2}", "tail\r"])) for n in range(40)]
    rows += [(100, None), (101, ""), (102, "head"), (103, "x" * 300_000 + "\nhead\n"), (104, "\n\n")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, dropped int")
    got = drop_repeated_lines(docs, min_docs=2, keep_first=keep_first)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == brute_lines(rows, 2, keep_first)


def test_lines_of_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (1, "a\nc"), (None, "c")], "doc_id long, text string")
    got = drop_repeated_lines(docs, min_docs=2, keep_first=False)
    assert sorted((r.doc_id or 0, r.kept_text) for r in got.collect()) == [(0, ""), (1, ""), (1, "b"), (1, "b")]
    assert drop_repeated_lines(docs.limit(0)).count() == 0


def test_bitmaps_hold_runs_of_kept_lines_without_texts(spark):
    docs = spark.createDataFrame([(1, "a\nx\ny\na\nz"), (2, "a"), (3, None), (4, "own\n\n")], "doc_id long, text string")
    got = keep_bitmaps(docs, min_docs=2, keep_first=False)
    assert got.columns == ["doc", "tie", "n_dropped", "keep_runs"]
    assert sorted((r.doc, r.n_dropped, [tuple(x) for x in r.keep_runs]) for r in got.collect()) == [(1, 2, [(1, 2), (4, 1)]), (2, 1, [])]
    whole = drop_repeated_lines(docs, min_docs=2, keep_first=False).collect()
    assert {r.doc_id: [tuple(x) for x in r.keep_runs] for r in whole}[4] == [(0, 3)]
