import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from eavista.functions.json_text import json_length, json_string_members
from eavista.functions.scalars import (
    active_text,
    blank_if_zero,
    canonical_id,
    days_after,
    matching_text,
    preferred_text,
    received_text,
    unsigned_cast,
)


def apply(spark, function, values, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    column = "v" if function in (json_length, json_string_members) else F.col("v")
    return [r[0] for r in frame.orderBy("i").select(function(column)).collect()]


def test_unsigned_cast(spark):
    cases = {
        "12abc": 12, "": 0, "abc": 0, " 5": 5, "\t5": 5, "3.7": 3, "+5": 5, "-1": 0, "007": 7,
        None: None, "99999999999999999999": 0, "12 3": 12,
    }
    assert apply(spark, unsigned_cast, cases) == list(cases.values())


def test_canonical_id(spark):
    cases = {"12": 12, "0": 0, "012": None, " 1": None, "1 ": None, "-1": None, None: None, "9" * 30: None}
    assert apply(spark, canonical_id, cases) == list(cases.values())


JSON_LENGTHS = {
    '["317"]': 1, '["1","2"]': 2, "[]": 0, '{"a":1,"b":2}': 2, "{}": 0, '"317"': 1, "3": 1,
    "true": 1, "null": 1, '[["a"],["b"]]': 2, "": None, "bad": None, '["a"': None, None: None,
}


def test_json_length(spark):
    assert apply(spark, json_length, JSON_LENGTHS) == list(JSON_LENGTHS.values())


JSON_MEMBERS = {
    '["317"]': ["317"],
    "[317]": [],
    '"317"': ["317"],
    '["1","2",null,3]': ["1", "2"],
    '[["317"]]': ["317"],
    '["a",["b",["c",{"k":"d"}]],{"z":["q"]}]': ["a", "b", "c"],
    '{"a":"1"}': [],
    '[{"a":"1"},"2"]': ["2"],
    '[["a \\" } b"],["{"],"c"]': ['a " } b', "{", "c"],
    '[["\\u0031"]]': ["1"],
    "[]": [],
    "": None,
    "bad": None,
    None: None,
}


def test_json_string_members(spark):
    assert apply(spark, json_string_members, JSON_MEMBERS) == list(JSON_MEMBERS.values())


def test_json_with_repeated_keys(spark):
    texts = ['{"a":1,"a":2}', '[{"a":1,"a":2},"5"]', '[{"a":{"b":"1"},"a":"{"},["}",{}],"5"]']
    assert apply(spark, json_length, texts) == [1, 2, 3]
    assert apply(spark, json_string_members, texts) == [[], ["5"], ["}", "5"]]


def test_json_is_strict(spark):
    texts = ['["1"] x', '["1"]] [', '["1"] ["2"]', '["1"]}', "['1']", '["\t"]', '["1",]', "01", "[01]", "NaN"]
    assert apply(spark, json_length, texts) == [None] * len(texts)
    assert apply(spark, json_string_members, texts) == [None] * len(texts)


def test_json_list_above_the_variant_limit(spark):
    long = F.concat(F.lit('["7",'), F.repeat(F.concat(F.lit('"'), F.repeat(F.lit("x"), 999), F.lit('",')), 140_000), F.lit('{},"8"]'))
    found = spark.range(1).select(long.alias("v")).select(
        F.length("v").alias("n"), json_length("v").alias("length"), json_string_members("v").alias("m")
    ).select("n", "length", F.size("m"), F.element_at("m", 1), F.element_at("m", -1), F.size(F.array_distinct("m")))
    n, *rest = found.first()
    assert n > 128 * 2**20 and rest == [140_003, 140_002, "7", "8", 3]


def test_one_string_above_the_limit_of_strings(spark):
    long = F.concat(F.lit('["7","'), F.repeat(F.lit("x"), 21_000_000), F.lit('"]'))
    found = spark.range(1).select(long.alias("v")).select(json_length("v"), F.length(json_string_members("v")[1]))
    assert tuple(found.first()) == (2, 21_000_000)


def nest(value, levels, opening, closing):
    return opening * levels + value + closing * levels


BEYOND = {
    nest('"a"', 5000, "[", "]"): (1, ["a"]),
    nest('"a"', 5000, "[", "]") + "]": (None, None),
    nest('"a"', 5000, '{"k":', "}"): (1, []),
    '["b",' + nest('"a"', 5000, '[{"k":', "}]") + ',"c"]': (3, ["b", "c"]),
    '{"' + "k" * 60_000 + '":1,"' + "k" * 60_000 + '":[2],"b":3}': (2, []),
    '{"' + "k" * 60_000 + "\t" + '":[1]}': (None, None),
    '["x",' + "1," * 30_000 + '[],": y",{"k":1}]': (30_004, ["x", ": y"]),
    "[" + "1" * 5000 + "]": (1, []),
    "[[" + "1" * 5000 + ',"a"]]': (1, ["a"]),
    "[" + ",".join(f'"{i}"' for i in range(100_000)) + "]": (100_000, [str(i) for i in range(100_000)]),
    "[" + ",".join(f'["{i}"]' for i in range(100_000)) + "]": (100_000, [str(i) for i in range(100_000)]),
    "[" + ",".join(f'{{"{i}":"v"}},"{i}"' for i in range(50_000)) + "]": (100_000, [str(i) for i in range(50_000)]),
    "{" + ",".join(f'"{i % 40_000}":[]' for i in range(100_000)) + "}": (40_000, []),
}


def test_json_of_any_size(spark):
    frame = spark.createDataFrame([(t,) for t in BEYOND], "v string")
    found = frame.select(json_length("v").alias("n"), json_string_members("v").alias("m")).collect()
    assert [(r.n, r.m) for r in found] == list(BEYOND.values())


def test_json_goes_on_behind_its_value(spark):
    texts = ['1,"c":2', '1],"c":[2', "1,2", '[1],[2]', '{"a":1},"b":{}', '[[1]],"l":[[2]]', '"x":1', '[{}]}', "{}{}", "[[]"]
    assert apply(spark, json_length, texts) == [None] * len(texts)


def members_of(value):
    if isinstance(value, str):
        return [value]
    return [m for part in value for m in members_of(part)] if isinstance(value, list) else []


def test_json_against_the_standard_parser(spark):
    """Random documents, and the same with one character taken out or put in."""
    rng = random.Random(3)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind >= 5:
            inner = [value(depth - 1) for _ in range(rng.randrange(4))]
            return inner if kind == 5 else dict(zip("abcd", inner))
        return (None, True, rng.randrange(-99, 99), rng.choice([1.5, -2e9, 0.25]), rng.choice(['', '1', 'é"', "[{,", "\\", "]}:"]))[kind]

    texts = []
    for _ in range(400):
        text = json.dumps(value(4), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        at = rng.randrange(len(text) + 1)
        texts += [text, text[:at] + text[at + 1:], text[:at] + rng.choice('[]{},:"1 ') + text[at:]]

    def expected(text):
        try:
            parsed = json.loads(text, parse_constant=lambda name: 1 / 0)
        except (ValueError, ZeroDivisionError):
            return None, None
        return (len(parsed) if isinstance(parsed, (list, dict)) else 1), members_of(parsed)

    wanted = [expected(text) for text in texts]
    assert apply(spark, json_length, texts) == [n for n, _ in wanted]
    assert apply(spark, json_string_members, texts) == [m for _, m in wanted]


def test_days_after_keeps_type(spark):
    def later(v):
        return days_after(v, 90)

    assert apply(spark, later, [dt.date(2024, 1, 1), None], "date") == [dt.date(2024, 3, 31), None]
    moment = dt.datetime(2024, 1, 1, 13, 5)
    assert apply(spark, later, [moment], "timestamp_ntz") == [dt.datetime(2024, 3, 31, 13, 5)]


def test_preferred_text(spark):
    def title(v):
        return preferred_text(v, F.lit("idea"))

    assert apply(spark, title, ["own", "", None, " "]) == ["own", "idea", "idea", " "]


@pytest.mark.parametrize(
    "text, expected",
    [
        (lambda v: active_text(v, F.lit(1), F.lit(None).cast("long")), "3 (1 Tecnología y 0 Ingeniería)"),
        (lambda v: received_text(v, F.lit(5)), "3 (5 estudiantes)"),
        (lambda v: matching_text(v, F.lit(4)), "3 (Corresponde a 4 estudiantes)"),
    ],
)
def test_composite_text(spark, text, expected):
    assert apply(spark, text, [3], "long") == [expected]


def test_blank_if_zero(spark):
    assert apply(spark, blank_if_zero, [0, 2, None], "long") == [None, 2, None]
