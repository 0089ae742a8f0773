from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palaver.functions import rules as R


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_addressing_and_precedence(spark):
    rows = [(True, None, [], []), (False, 7, [], []), (False, None, [7], []), (False, None, [], [3]), (False, None, [8], [1]), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "d boolean, r long, m array<bigint>, o array<bigint>")
    got = [r[0] for r in frame.select(R.is_addressed(F.col("d"), F.col("r"), F.col("m"), F.col("o"), 7, [3])).collect()]
    assert got == [True, True, True, True, False, False]
    assert value(spark, R.first_given(F.lit(None).cast("string"), F.lit(" "), F.lit("user"), default=F.lit("x"))) == "user"


@pytest.mark.parametrize(("complexity", "thinking", "tier"), [(None, None, "low"), ("High ", None, "high"), ("medium", "high", "medium"), ("low", "high", "high"), ("low", "low", "medium")])
def test_output_tiers(spark, complexity, thinking, tier):
    assert value(spark, R.output_tier(F.lit(complexity).cast("string"), F.lit(thinking).cast("string"))) == tier


def test_reasons_quotas_and_json(spark):
    assert [value(spark, R.finish_reason(F.lit(x).cast("string"))) for x in ("FinishReason.STOP", "blocklist", "3", None, "odd")] == [1, 3, 3, 0, 0]
    assert [r["requests_per_minute"] for r in R.quotas(spark).orderBy("tier").collect()] == [15, 2000]
    assert [value(spark, R.json_ids(F.lit(x))) for x in ('[1, "2", "x"]', '[["5"], ["6"]]')] == [[1, 2], [5]]
    assert value(spark, R.json_ids(F.lit("nonsense"))) is None
    assert value(spark, R.timeout_seconds(F.lit("HIGH"))) == 120 and value(spark, R.timeout_seconds(F.lit("minimal"))) == 30


def test_validation(spark):
    faults = R.faults_of_message(F.lit(""), F.lit(0), F.lit(None).cast("int"), F.lit(True), F.lit(None).cast("int"))
    assert value(spark, faults) == ["author is empty", "message id isn't positive", "a reply without its target"]
    assert value(spark, R.faults_of_usage(F.lit(5), F.lit(1), F.lit(3))) == ["total below its parts"]
    assert value(spark, R.limits_in_order(F.lit(4), F.lit(8), F.lit(12))) and not value(spark, R.limits_in_order(F.lit(4), F.lit(3), F.lit(12)))
    assert value(spark, R.image_faults(F.lit(10), F.lit("BMP"), F.lit(20), F.lit(100), 5, ["png"])) == ["too large", "format not supported", "too small"]


def test_context_rows(spark):
    pins = spark.createDataFrame([(1, 20, "text", "Ann", "Bo", "2024-05-01 12:00:00"), (2, 20, "more", "Cy", "Bo", "odd")], "id long, channel_id long, content string, author_name string, pinned_by string, pinned_at string")
    rows = R.pin_context(pins, F.lit("2024-06-01").cast("timestamp")).orderBy("message_id").collect()
    assert rows[0]["message_id"] == 9_000_000_000_000_000_001 and rows[0]["timestamp"] == datetime(2024, 5, 1, 12) and rows[1]["timestamp"] == datetime(2024, 6, 1)
    block = R.numbered_lines(pins, "channel_id", ["id"], F.concat(F.lit("[Pin #"), F.col("id").cast("string"), F.lit("] "), "content")).first()
    assert block["block"] == "[Pin #1] text\n[Pin #2] more" and block["lines"] == 2
    entry = lambda *x: F.array(*[F.struct(F.lit(a).alias("author"), F.lit(t).alias("text")) for a, t in x])
    assert value(spark, R.live_prompt(entry(("a", "hi")))) == "hi" and value(spark, R.live_prompt(entry(("a", "hi"), ("b", "yo")))) == R.LIVE_HEAD + "- a: hi\n- b: yo" + R.LIVE_FOOT
    assert [value(spark, R.media_kind(F.lit(n), F.lit(t).cast("string"))) for n, t in (("a.PNG", None), ("b", "audio/ogg"), ("c.zip", None))] == ["image", "audio", "other"]
    chunks = F.from_json(F.lit('[{"web": {"uri": "u", "title": "t"}}, {"web": null}]'), "array<struct<web: struct<uri: string, title: string>>>")
    assert [tuple(x) for x in value(spark, R.grounding_sources(chunks))] == [("u", "t")]


def test_faults_of_answers_and_edits(spark):
    none, yes, no = F.lit(None), F.lit(True), F.lit(False)
    text = none.cast("string")
    assert value(spark, R.faults_of_response(yes, F.lit(""), text, F.lit(-1), no)) == ["a success without content", "a negative wait"]
    assert value(spark, R.faults_of_response(no, text, text, none.cast("int"), yes)) == ["a failure without an error type", "token usage of a failure"]
    assert value(spark, R.faults_of_response(yes, F.lit("x"), text, none.cast("int"), yes)) == value(spark, R.faults_of_response(no, text, F.lit("timeout"), F.lit(3), no)) == []
    assert value(spark, R.faults_of_edit_request(F.lit(""), F.lit(b""), F.lit(" \n "), text)) == ["no user", "no image", "no instruction", "no channel"]
    assert value(spark, R.faults_of_edit_request(F.lit("u"), F.lit(b"x"), F.lit(" do "), F.lit("c"))) == []
    assert value(spark, R.faults_of_edit_result(yes, none.cast("binary"), text, F.lit(-0.5))) == ["a success without an image", "a negative time"]
    assert value(spark, R.faults_of_edit_result(no, none.cast("binary"), text, F.lit(1.0))) == ["a failure without a message"]
    assert value(spark, R.faults_of_validation(no, text, F.lit(-1.0), F.lit(0), F.lit(5))) == ["invalid without a message", "a negative size", "no dimensions"]
    assert value(spark, R.faults_of_validation(yes, text, none.cast("double"), none.cast("int"), none.cast("int"))) == []


GOOD = {
    "context.max_messages": 10, "context.max_images": 0, "context.context_messages_low": 1, "context.context_messages_medium": 5, "context.context_messages_high": 5, "reports.web_port": 80, "rag.enabled": True, "rag.embedding_model": "m",
    "rag.lexical_candidates": 4, "rag.semantic_candidates": 4, "rag.backfill_limit": 0, "generation.temperature": 2.0, "image_processing.max_size_mb": 25, "messages.split_length": 100, "models.valid": ["a", "b"], "models.default": "a",
    "models.router": "b", "models.available": ["a"], "models.thinking_backend": {"a": "None", "b": "thinking_level"}, "model_complexity": {t: {"model": "a", "thinking_level": "High "} for t in ("low", "medium", "high")},
    "rate_limiting.text_rate_limit_per_minute": 5, "rate_limiting.text_rate_limit_per_hour": 5, "bot.token_db_path": "x",
}
KINDS = {bool: "boolean", int: "bigint", float: "double", str: "string", list: "array<string>"}


def config_faults(spark, **changed):
    settings = GOOD | {k.replace("__", "."): v for k, v in changed.items()}
    kinds = {k: KINDS.get(type(GOOD[k]), "map<string,string>" if k == "models.thinking_backend" else "map<string,struct<model:string,thinking_level:string>>") for k in GOOD}
    frame = spark.createDataFrame([tuple(settings.values())], ", ".join(f"{k.replace('.', '_')} {t}" for k, t in kinds.items()))
    return frame.select(R.faults_of_config(kinds)).first()[0]


def test_faults_of_a_configuration(spark):
    assert config_faults(spark) == []
    assert config_faults(spark, context__max_messages=0, context__max_images=-1, reports__web_port=70_000) == ["context.max_messages must be positive", "context.max_images must be zero or positive", "reports.web_port must be between 1 and 65535"]
    assert config_faults(spark, context__context_messages_low=9) == ["context.context_messages_low <= medium <= high is required"]
    assert config_faults(spark, context__context_messages_high=None, bot__token_db_path="  ") == ["bot.token_db_path must not be empty", "context.context_messages_low/medium/high must all be positive", "context.context_messages_low <= medium <= high is required"]
    assert config_faults(spark, rag__lexical_candidates=0, rag__embedding_model="") == ["rag.lexical_candidates must be positive", "rag.embedding_model must not be empty"]
    assert config_faults(spark, rag__enabled=False, rag__lexical_candidates=0) == []
    assert config_faults(spark, models__router="c", models__available=["a", "z"]) == ["models.router must be one of models.valid", "models.available values must all exist in models.valid"]
    assert config_faults(spark, models__thinking_backend={"a": "odd", "c": "none"}) == ["models.thinking_backend keys must be present in models.valid", "models.thinking_backend values must be known", "models.thinking_backend is missing model entries"]
    assert config_faults(spark, model_complexity={"low": {"model": "z", "thinking_level": "odd"}, "medium": GOOD["model_complexity"]["low"]}) == ["model_complexity is missing high", "model_complexity.low.model must be one of models.valid", "model_complexity.low.thinking_level must be known"]
    assert config_faults(spark, rate_limiting__text_rate_limit_per_hour=3, messages__split_length=2001) == ["messages.split_length must be between 100 and 2000", "rate_limiting.text_rate_limit_per_minute cannot exceed text_rate_limit_per_hour"]
    assert config_faults(spark, image_processing__max_size_mb=26, generation__temperature=2.1) == ["generation.temperature must be between 0.0 and 2.0", "image_processing.max_size_mb must be at most 25"]


def test_image_entry(spark):
    entry = value(spark, R.image_entry(F.lit("reply"), F.lit(5), F.lit("2024-05-01 12:00:00").cast("timestamp"), F.lit("Ann"), F.lit("a.png"), F.lit(1), F.lit(None).cast("int")))
    assert tuple(entry) == ("reply", 5, "2024-05-01T12:00:00Z", "Ann", "a.png", 1, None)
