"""Rules over nested documents, and applicability over several attributes, against plain Python."""

import itertools
import json
import random
import re

import pytest

from furrow.operators import catalog as C
from furrow.operators import quality as Q

RULES = [
    ("$", "TYPE", '"object"'), ("$", "REQUIRED", '["a", "b"]'), ("$", "ONLY_KEYS", '["a", "b", "c", "d"]'), ("$", "MIN_PROPERTIES", "2"), ("$", "MAX_PROPERTIES", "3"), ("$.a", "TYPE", '["integer", "null"]'), ("$.a", "MINIMUM", "0"), ("$.a", "EXCLUSIVE_MAXIMUM", "10"), ("$.a", "ENUM", '[1, 2.0, "x", null, [1, {"k": 2}], 11]'),
    ("$.b", "TYPE", '"array"'), ("$.b", "MIN_ITEMS", "1"), ("$.b", "MAX_ITEMS", "3"), ("$.b", "UNIQUE_ITEMS", "true"), ("$.b[*]", "TYPE", '["number", "string", "object", "array"]'), ("$.b[*].k", "EXCLUSIVE_MINIMUM", "1.5"), ("$.b[*][*]", "MAXIMUM", "4"), ("$.c", "PATTERN", '"[a-c]+"'), ("$.c", "MIN_LENGTH", "2"), ("$.c", "MAX_LENGTH", "3"),
    ("$.d", "CONST", '{"y": [true, "q"], "x": 1}'),
]


def places(v, path):
    here = [("$", v)]
    for step in re.findall(r"\[\*\]|[^.\[\]$]+", path):
        if step == "[*]":
            here = [(f"{p}[{i}]", y) for p, x in here if isinstance(x, list) for i, y in enumerate(x)]
        else:
            here = [(f"{p}.{step}", x[step]) for p, x in here if isinstance(x, dict) and step in x]
    return here


def broken(x, rule, arg):
    number = isinstance(x, int | float) and not isinstance(x, bool)
    same = lambda a, b: a == b if isinstance(a, bool) == isinstance(b, bool) else False
    kinds = {"object": isinstance(x, dict), "array": isinstance(x, list), "integer": number and isinstance(x, int), "number": number, "string": isinstance(x, str), "null": x is None, "boolean": isinstance(x, bool)}
    names = arg if isinstance(arg, list) else [arg]
    return {
        "TYPE": lambda: not any(kinds[n] for n in names), "REQUIRED": lambda: isinstance(x, dict) and bool(set(arg) - set(x)), "ONLY_KEYS": lambda: isinstance(x, dict) and bool(set(x) - set(arg)),
        "MIN_PROPERTIES": lambda: isinstance(x, dict) and len(x) < arg, "MAX_PROPERTIES": lambda: isinstance(x, dict) and len(x) > arg, "MINIMUM": lambda: number and x < arg, "EXCLUSIVE_MINIMUM": lambda: number and x <= arg,
        "MAXIMUM": lambda: number and x > arg, "EXCLUSIVE_MAXIMUM": lambda: number and x >= arg, "ENUM": lambda: not any(same(x, y) for y in arg), "CONST": lambda: not same(x, arg), "MIN_ITEMS": lambda: isinstance(x, list) and len(x) < arg,
        "MAX_ITEMS": lambda: isinstance(x, list) and len(x) > arg, "UNIQUE_ITEMS": lambda: isinstance(x, list) and len({json.dumps(i, sort_keys=True) for i in x}) < len(x), "PATTERN": lambda: isinstance(x, str) and not re.fullmatch(arg, x),
        "MIN_LENGTH": lambda: isinstance(x, str) and len(x) < arg, "MAX_LENGTH": lambda: isinstance(x, str) and len(x) > arg,
    }[rule]()


def test_rules_hold_as_in_plain_python(spark):
    rng = random.Random(5)
    leaf = lambda: rng.choice([0, 1, 2.0, -3, 11, 4.5, True, None, "x", "ab", "abcd", "é1", ""])
    thing = lambda: rng.choice([leaf(), [leaf() for _ in range(rng.randint(0, 4))], {"k": leaf()}, [1, {"k": 2}], [[1, 9], [5]], [{"k": 1, "j": 2}, {"j": 2, "k": 1}]])
    docs = [{k: thing() for k in "abcde" if rng.random() < 0.7} for _ in range(150)] + [[], 5, "text", None, {"d": {"x": 1, "y": [True, "q"]}}, {"d": {"x": 1.0, "y": [True]}}]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(900, "{not json"), (901, None)]
    out = Q.check_documents(spark.createDataFrame(rows, "row_id int, json string"), spark.createDataFrame(RULES, "path string, rule string, arg string"))
    want = {(i, at, rule) for i, d in enumerate(docs) for path, rule, arg in RULES for at, x in places(d, path) if broken(x, rule, json.loads(arg))}
    got = [(r["row_id"], r["path"], r["rule"]) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want | {(900, "$", "NOT_JSON")}
    with pytest.raises(ValueError, match="no such check"):
        Q.check_documents(spark.createDataFrame(rows, "row_id int, json string"), spark.createDataFrame([("$", "ODD", None)], "path string, rule string, arg string"))


def test_applicability_is_the_plain_rule(spark):
    rng = random.Random(6)
    some = lambda *names: rng.sample(names, rng.randint(1, 2))
    models = [(i, some("BR", "AR", "ALL"), some("CORN", "CANE", "ANY"), some("SP", "BR-RS", "SOUTH", "ALL", "X_WITH_JUSTIFICATION", "CENTER")) for i in range(60)]
    contexts = [(i, *x) for i, x in enumerate(itertools.product(("BR", "AR", None), ("CORN", "CANE"), ("SP", "RS", "MT"), (None, " ", "trials")))]
    regions = [("RS", "SOUTH"), ("MT", "CENTER"), ("RS", "CENTER"), ("RS", "SOUTH")]
    want = {}
    for m, countries, crops, places_ in models:
        for x, country, crop, state, why in contexts:
            tags = {t for s, t in regions if s == state} | {state, f"{country}-{state}" if country else state}
            if not (country in countries or "ALL" in countries) or not (crop in crops or "ANY" in crops):
                continue
            plain = 0 if tags & set(places_) else 1 if "ALL" in places_ else None
            stars = (country not in countries) + (crop not in crops)
            if plain is not None:
                want[m, x] = ("EXACT_OR_NATIONAL", stars + plain)
            elif "X_WITH_JUSTIFICATION" in places_:
                want[m, x] = ("JUSTIFIED_EXTRAPOLATION" if (why or "").strip() else "NEEDS_JUSTIFICATION", stars)
    out = C.applicability(
        spark.createDataFrame(models, "model_id int, countries array<string>, crops array<string>, jurisdictions array<string>"),
        spark.createDataFrame(contexts, "context_id int, country string, crop string, state string, justification string"),
        spark.createDataFrame(regions, "state string, tag string"),
    )
    got = {(r["model_id"], r["context_id"]): (r["how"], r["wildcards"]) for r in out.collect()}
    assert got == want
