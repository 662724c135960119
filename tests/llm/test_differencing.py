from __future__ import annotations

import random

from lectern.llm.differencing import common_lines, differenced, note_pages, without_shared


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(12))] for _ in range(2))
        at = common_lines(a, b)
        assert at == sorted(at) and len(at) == longest(a, b)
        rest = iter(b)
        assert all(a[k] in rest for k in at)


def test_pages_lose_what_they_share_with_their_nearest(spark):
    frame = "<html>\n<nav>home</nav>\n{}\n</html>"
    rows = [("h", "a/1", 1, frame.format("one")), ("h", "a/2", 2, frame.format("two")), ("h", "b/1", 3, "other\ntext"), ("g", "a/1", 4, frame.format("one")), (None, None, 5, None), ("h", "a/3", 6, "")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "host string, path string, id long, text string, own_text string")
    got = {r["id"]: (r["own_text"], r["n_shared"]) for r in differenced(df).collect()}
    assert got[1] == ("one", 3) and got[2] == ("two", 3) and got[3] == ("other\ntext", 0) and got[4] == (frame.format("one"), 0) and got[5] == (None, 0) and got[6] == ("", 0)
    assert differenced(df.where("false")).count() == 0
    assert without_shared("a\n\nb", "x\n\ny") == ("a\n\nb", 0)


def test_pages_of_notes(spark):
    notes = spark.createDataFrame([(1, 7, 2, "t"), (2, 8, None, "u"), (None, 7, 1, "v")], "id int, document_id int, page int, text string")
    docs = spark.createDataFrame([(7, "up/board/x.png"), (7, "up/board/x.png"), (8, None)], "id int, file_path string")
    assert sorted(map(tuple, note_pages(notes, docs).collect())) == [("documents/", "8#000000", 2, "u"), ("up/board/", "x.png#000002", 1, "t")]
