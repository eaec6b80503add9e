"""Porter stemming (F15) and the fixed vocabularies."""

from logweave.functions.stem import porter_stem, stem_table
from logweave.functions.vocab import significant_stems, stop_words

CASES = {
    "caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "feed": "feed", "agreed": "agre",
    "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "digitizer": "digit", "operator": "oper", "hopefulness": "hope", "goodness": "good",
    "adjustment": "adjust", "adoption": "adopt", "activate": "activ", "effective": "effect", "generously": "gener",
    "failure": "failur", "releasing": "releas", "release": "releas", "dropped": "drop", "dying": "die",
    "exceed": "exceed", "exceeded": "exceed", "invalidation": "invalid", "bytes": "byte", "mcs": "mc",
}


def test_porter_cases():
    assert {w: porter_stem(w) for w in CASES} == CASES


def test_significant_stems_keep_unstemmed_literal():
    s = significant_stems()
    assert len(s) == 16 and s[-1] == "failure" and "releas" in s and "fail" in s
    # a stemmed template word never equals the literal
    assert porter_stem("failure") != "failure"


def test_stop_words_cover_published_surplus():
    sw = set(stop_words())
    assert {"for", "after", "have", "in", "on", "this"} <= sw


def test_stem_table_distinct(spark):
    df = spark.createDataFrame([("failed",), ("failed",), ("nack",)], "word string")
    got = {r.word: r.stem for r in stem_table(df).collect()}
    assert got == {"failed": "fail", "nack": "nack"}
