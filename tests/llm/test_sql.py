"""Queries against their DuckDB SQL: on the small tables, on rows with every odd case, on empty tables and on planted cases."""

import random
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from llm_rows import DIGITS, prose, rows, write

from lamellar.llm.queries import ORACLES, QUERIES


def plain(v):
    return "" if v is None else repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def same(spark, folder, name) -> list:
    """The query's rows, found equal to those of its SQL."""
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    df = QUERIES[name](spark, folder)
    got, cur = df.collect(), con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in df.columns]
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    return got


@pytest.mark.parametrize("name", list(ORACLES))
def test_small_tables(spark, small, name):
    assert same(spark, small, name)


@pytest.mark.parametrize("name", list(ORACLES))
def test_empty_tables(spark, tmp_path, name):
    assert same(spark, write(spark, tmp_path, []), name) == []


@pytest.mark.parametrize("name", sorted(set(ORACLES) - {"op4_quality_rules"}))
def test_odd_rows(spark, tmp_path, name):
    """Without the runs of 60,000 digits, on which DuckDB's patterns are slow, and without the query whose SQL needs unique ids."""
    pages = [(1, "http://a.net/x"), (2, "https://b.example.net/en/1"), (3, "http://example.com/de/1"), (4, "http://q.org/fr/"), (5, "http://q.com/1"), (6, None), (7, "nothing"), (8, "HTTP://A.NET"), (None, "http://q.com/1?x#y"), (8, "HTTP://A.NET"), (9, ""), (10, "http://é.net/ü")]
    talk = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "On Monday A wrote:\n> How are you?\nFine."), (1, 2, "user", "> > How are you?\n> Fine.\nGood"), (None, None, None, None), (2, 0, "user", ""), (2, 0, "user", ""), (2, 1, None, "> never said")]
    data = [r for r in rows() if DIGITS not in (r[1] or "")]
    folder = write(spark, tmp_path, data, [(1, prose(4, 60)), (2, None), (3, ""), (4, "one"), (5, "one two")], [(i, u, None) for i, u in pages], talk)
    assert same(spark, folder, name)


def test_substituted_passages(spark, tmp_path):
    r = random.Random(8)
    items = [(k, prose(100 + k, n)) for k, n in enumerate([40, 20, 13, 9, 4, 2, 1, 7, 3])] + [(17, None), (18, ""), (None, prose(130, 25)), (20, prose(100, 40)), (21, "a b " * 40)]
    texts = [None, "", items[0][1], items[5][1].upper() + ".", items[6][1], "b a " * 100 + prose(5, 20), "a b c " * 50]
    for _, text in items[:9]:
        for cuts in range(4):
            w = text.split()
            for _ in range(cuts):
                w[r.randrange(len(w))] = "other"
            texts.append(f"{prose(r.randrange(10**6), 30)} {' '.join(w[r.randrange(max(1, len(w) - 14)):])}. {prose(300 + cuts, 20)}")
    folder = write(spark, tmp_path, [(i, t, *(None,) * 11) for i, t in enumerate(texts)], items)
    assert len(same(spark, folder, "op3_decontaminate")) > 20


def test_quotes_at_levels(spark, tmp_path):
    r, talk, said = random.Random(9), [], []
    for k in range(90):
        text = []
        for level in range(1, 4):
            if said and r.random() < 0.5:
                lines = r.choice(said)
                lo = r.randrange(len(lines))
                text += ["> " * level + x for x in lines[lo : lo + r.randint(1, 4)]]
        said.append([prose(r.randrange(10**6), r.randint(1, 5)) if r.random() < 0.8 else r.choice(["yes", "no", "", "On Monday A wrote:"]) for _ in range(r.randint(1, 6))])
        talk.append((k % 2, k, "u", "\n".join(text + said[-1])))  # equal turns go by place, which files change
    got = same(spark, write(spark, tmp_path, [], conversations=talk), "op6_quotation_linking")
    assert sum(x.parent_turn is not None for x in got) > 20


def test_urls_of_both_kinds(spark, tmp_path):
    r = random.Random(3)
    pages = [(i, f"http://{r.choice(['a', 'bb', 'shop'])}{i}.{r.choice(['net', 'org/fr', 'com', 'net/en', 'org'])}/{prose(i, 2).replace(' ', '/')}", None) for i in range(300)]
    got = same(spark, write(spark, tmp_path, [], pages=pages + pages[:40]), "op5_url_filter")
    assert {x.verdict for x in got if x.rule is None} == {"allow", "block"}


def test_terms_that_disclose(spark, tmp_path):
    texts = [f"{prose(i, 12)} Kowalczyk x.kow@mail.example {prose(50 + i, 12)}" for i in range(5)]
    texts += [f"{prose(90, 20)} KOWALCZYK, {prose(91, 20)}", *texts[:1] * 5, *(prose(400 + i, 40) for i in range(200))]
    page = prose(700, 40).split()  # near copies of one passage tell nothing
    texts += [" ".join([*page[: 14 + i % 8], f"new{chr(97 + i)}", *page[15 + i % 8 : 20], "10.1.2.3", "verbatim", *page[20:]]) for i in range(12)]
    got = same(spark, write(spark, tmp_path, [(i, t, *(None,) * 11) for i, t in enumerate(texts)]), "op9_pii")
    assert sum("term" in x.spans for x in got) == 11
