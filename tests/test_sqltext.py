import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from worklens.functions import sqltext
from worklens.functions.text import spaced_json, strip

X = F.col("x")


def test_same_structure_gives_same_fingerprint(one):
    got = one(
        [
            "SELECT * FROM users WHERE email = 'user@example.com'",
            "select  *\nfrom users where email = 'o''brien'",
            "SELECT * FROM users WHERE email = $1",
        ],
        sqltext.fingerprint(X),
    )
    assert len(set(got)) == 1 and "?" in got[0]


def test_lists_and_squashed_lists_are_equal(one):
    got = one(
        [
            "SELECT * FROM t WHERE id IN (1, 2, 3)",
            "select * from t where id in ($1, $2, $3)",
            "SELECT * FROM t WHERE id IN ($1 /*, ... */)",
        ],
        sqltext.fingerprint(X),
    )
    assert set(got) == {"SELECT * FROM T WHERE ID IN (?)"}


@pytest.mark.parametrize(
    "query,expected",
    [
        ("SELECT NOW()", "SELECT NOW(?)"),
        ("VALUES (1),(2)", "VALUES (?),(?)"),
        ("a = -3", "A = -?"),
        ("t1 1e5 0x1F 1.5", "T1 1E5 0X1F ?"),
        ('SELECT "Users".id, 1.5 FROM "Users" WHERE name = \'x\'', 'SELECT "USERS".ID, ? FROM "USERS" WHERE NAME = ?'),
        ("a  b -- c 7", "A B -- C ?"),
        ("'a''", "?'"),
    ],
)
def test_fingerprint_details(one, query, expected):
    assert one([query], sqltext.fingerprint(X)) == [expected]


def test_flags_switch_steps_off(one):
    q = ["Select  1"]
    assert one(q, sqltext.fingerprint(X, normalize_literals=False)) == ["SELECT 1"]
    assert one(q, sqltext.fingerprint(X, normalize_whitespace=False)) == ["SELECT  ?"]
    assert one(q, sqltext.fingerprint(X, case_insensitive=False)) == ["Select ?"]


def test_long_literals_do_not_overflow(one):
    texts = ["SELECT '" + "a" * 200_000 + "'", "SELECT '" + "''" * 50_000 + "'", "SELECT '" + "''" * 50_000]
    got = one(texts, sqltext.fingerprint(X))
    assert got[0] == got[1] == "SELECT ?" and got[2].startswith("SELECT ?")


def test_literals_match_backtracking_semantics(one):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["'", "''", "a", " ", "b", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    got = one(texts, F.regexp_replace(X, sqltext.fixed.QUOTED_LITERAL, "?"))
    assert got == [re.sub(r"'([^']|'')*'", "?", t) for t in texts]


def test_hash_is_start_of_sha256(one):
    assert one(["select 1"], sqltext.query_hash(X)) == [hashlib.sha256(b"SELECT ?").hexdigest()[:16]]


def test_query_types(one):
    cases = {
        " \n select 1": "SELECT", "INSERT INTO t": "INSERT", "withdraw": "WITH", "EXPLAIN x": "OTHER",
        "": "OTHER", "truncate t": "TRUNCATE", "rollback": "ROLLBACK",
    }
    assert one(list(cases), sqltext.query_type(X)) == list(cases.values())


def test_table_names(one):
    cases = {
        "SELECT u.*, o.* FROM users u JOIN orders o ON u.id = o.user_id": ["users", "orders"],
        "SELECT EXTRACT(YEAR FROM created_at) FROM events": ["events"],
        'DELETE FROM "Users" WHERE 1=1': ["Users"],
        "INSERT INTO a.b SELECT * FROM c ON CONFLICT DO UPDATE SET x = 1": ["c", "a.b"],
        "SELECT 1": [],
    }
    assert one(list(cases), sqltext.tables(X)) == list(cases.values())


def test_strip_and_json_spacing(one):
    assert one(["  a b\t\n"], strip(X)) == ["a b"]
    got = one(['{"a":"x, y: z","b":[1,2],"c":"é😀\\"q"}'], spaced_json(X))
    assert got == ['{"a": "x, y: z", "b": [1, 2], "c": "\\u00e9\\ud83d\\ude00\\"q"}']
