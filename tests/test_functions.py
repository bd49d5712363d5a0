"""Golden rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from batchloom.functions import answers, scalars, timing
from batchloom.functions.phone import phone_flag

PHONES = [  # text, executed, intended
    ("Phone: 555-123-4567", True, True),
    ("5500000042", True, True),
    ("+1 (555) 010-1234", False, True),
    ("12345678901", False, False),
    ("12025550123", False, True),
    ("0123456789", False, False),
    ("9876543210", False, False),
    ("1111111111", False, False),
    ("1234567890", True, True),
    ("Order id 5500000042", False, False),
    ("David 5500000042", False, False),
    ("telephone: 555-1234", False, False),
    ("tel: 07123456789", True, True),
    ("call (123) 456-7890", False, True),
    ("N/A", False, False),
    (" n/a ", False, False),
    ("\tN/A\n", False, False),
    ("", False, False),
    (None, False, False),
    # the first hit of a shape counts: a formatted number does not settle it, a later bare one of another shape does
    ("ring 123-456-7890 or 2025550123", True, True),
    # a test number stops the search before the announced one is looked at
    ("1111111111 phone: 2025550123-", False, False),
    ("é2025550123", False, False),
    ("tél: 0612345678", True, True),
    ("电: 5551234567", True, True),
]


@pytest.mark.parametrize("mode", ["executed", "intended"])
def test_phone_flag(spark, mode):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PHONES)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", phone_flag(F.col("t"), mode).alias("v")).collect()}
    wrong = [(p, got[i]) for i, p in enumerate(PHONES) if got[i] != p[1 if mode == "executed" else 2]]
    assert not wrong


def test_phone_mode_is_checked():
    with pytest.raises(ValueError):
        phone_flag(None, "other")


def test_answers(spark):
    full = ('{"store_image": true, "text_content": "t", "store_name": null, '
            '"business_contact": "Phone: 555-123-4567", "image_description": "d"}')
    texts = {
        "fenced": f"```json\n{full}\n```", "plain": f"  {full} ", "yes": '{"store_image": "Yes"}',
        "text": "not json: " + "x" * 300, "list": "[1, 2]", "number": "5", "null_json": "null", "empty": "", "null": None,
        "blank": "  ", "bare_fence": f"```{full}```", "trailing": f"```json\n{full}\n``` and a remark",
        "two": '{"a": 1} {"b": 2}', "twice": '{"store_name": "a", "store_name": "b"}',
        "number_contact": '{"business_contact": 5551234567}', "zero_contact": '{"business_contact": 0}',
    }
    df = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = {r.k: r for r in answers.normalize_response(df, "t").collect()}
    assert len(got) == len(texts)
    for k in ("fenced", "plain"):
        r = got[k]
        assert (r.success, r.store_image, r.text_content, r.store_name, r.phone_number) == (True, True, "t", None, True)
    assert (got["yes"].success, got["yes"].store_image, got["yes"].phone_number) == (True, True, False)
    assert got["yes"].text_content is None and got["yes"].image_description is None
    r = got["text"]
    assert (r.success, r.store_image, r.phone_number, r.error) == (True, False, False, None)
    assert r.text_content == texts["text"] and r.image_description == texts["text"][:200]
    for k in ("list", "number", "null_json", "empty", "null", "number_contact"):
        assert (got[k].success, got[k].store_image, got[k].phone_number) == (False, None, None) and got[k].error
    # what is not JSON from end to end is a text
    for k in ("bare_fence", "trailing", "two", "blank"):
        assert got[k].success and got[k].store_image is False and got[k].store_name is None
    assert got["twice"].store_name == "b"
    assert got["zero_contact"].success and got["zero_contact"].phone_number is False


def test_decode_drops_unreadable(spark):
    df = spark.createDataFrame([(1, '{"store_name": "a"}'), (2, "{oops"), (3, None)], "i int, t string")
    assert [(r.i, r.store_name) for r in answers.decode_analysis(df, "t").collect()] == [(1, "a")]


def _one(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


def test_times(spark):
    t = timing.moment
    assert _one(spark, timing.iso_text(t("2024-01-02 03:04:05"))) == "2024-01-02T03:04:05"
    assert _one(spark, timing.iso_text(t("2024-01-02 03:04:05.25"))) == "2024-01-02T03:04:05.250000"
    assert _one(spark, timing.iso_text(F.lit(None).cast("timestamp"))) is None
    assert _one(spark, timing.minutes_between(t("2024-01-01 00:00:00"), t("2024-01-01 00:01:30"))) == 1.5


def test_rate_and_eta(spark):
    now = timing.moment("2024-01-01 01:00:00")

    def rate(processed, started):
        return _one(spark, scalars.processing_rate(F.lit(processed), timing.moment(started), now))

    assert rate(120, "2024-01-01 00:00:00") == 2.0
    assert rate(0, "2024-01-01 00:00:00") == 0.0
    assert rate(120, "2024-01-01 00:59:30") == 0.0
    assert _one(spark, scalars.processing_rate(F.lit(5), F.lit(None).cast("timestamp_ntz"), now)) == 0.0
    due = scalars.eta(F.lit(11), F.lit(10), F.lit(0.8), now)
    assert str(_one(spark, due)) == "2024-01-01 01:01:15"
    assert _one(spark, scalars.eta(F.lit(11), F.lit(10), F.lit(0.0), now)) is None


def test_small_scalars(spark):
    assert [_one(spark, scalars.retry_delay(F.lit(n))) for n in (1, 2, 3, 500)] == [120, 240, 300, 300]
    assert [_one(spark, scalars.poll_interval(F.lit(float(p)), F.lit(True))) for p in (0, 10, 50, 90)] == [5, 10, 15, 5]
    assert _one(spark, scalars.poll_interval(F.lit(0.0), F.lit(False))) == 30
    assert _one(spark, scalars.estimate_hours(F.lit(7200), 2)) == 4.0
    assert _one(spark, scalars.estimate_hours(F.lit(7200), 2, per_key_rate=False)) == 1.0
    d = _one(spark, scalars.resize_dims(F.lit(4096), F.lit(1001)))
    assert (d.width, d.height) == (2048, 500)
    d = _one(spark, scalars.resize_dims(F.lit(2048), F.lit(10)))
    assert (d.width, d.height) == (2048, 10)
    assert _one(spark, scalars.payload_problem(F.lit("b"), F.lit(""), F.lit(3))) == "chunk_id"
    assert _one(spark, scalars.payload_problem(F.lit("b"), F.lit("c"), F.lit(3))) is None
