"""Queries on prompts, decoding and scoring."""

from __future__ import annotations

import uuid

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.numbers import both_classes, positive_class
from ..operators import decode, inference
from ..operators.prompt import ChatTemplate, PromptConfig, Prompts
from ..operators.task import Choice, MultipleChoice, Numeric, Task
from ..operators.threshold import Threshold
from ..operators.valuemap import ColumnToText
from .benchmark import Benchmark, Config
from .registry import HASH32, SCORES, query, rounded, scores, table

LIMIT = Threshold(1000, ">")
MC = MultipleChoice("p_retailprice>1000", "Is the part expensive?", (Choice("No", 0), Choice("Yes", 1)))
NUM = Numeric("p_retailprice>1000", "What is the probability that the part is expensive?")
SIZES = {i: f"size class {i}" for i in range(1, 40)}
TASK = Task("parts", "The following data describes a part.\n", ("p_brand", "p_type", "p_size"), "p_retailprice", LIMIT, None, {"p_brand": ColumnToText("p_brand", "brand", lambda x: x), "p_type": ColumnToText("p_type", "type", lambda x: x, "unknown"), "p_size": ColumnToText("p_size", "size", SIZES)}, MC, NUM)

_SIZE = "CASE WHEN p_size BETWEEN 1 AND 39 THEN 'size class ' || CAST(p_size AS VARCHAR) ELSE 'N/A' END"
_INFO = f"'Information:' || chr(10) || '- The brand is: ' || p_brand || '.' || chr(10) || '- The type is: ' || p_type || '.' || chr(10) || '- The size is: ' || regexp_replace({_SIZE}, '[, \\n]+$', '') || '.'"
_ASK = "chr(10) || chr(10) || 'Question: Is the part expensive?' || chr(10) || 'A. No.' || chr(10) || 'B. Yes.' || chr(10) || 'Answer:'"
_DESCRIPTION = "'The following data describes a part.' || chr(10) || chr(10)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return LIMIT.add(table(spark, d, "part"), "p_retailprice")


@query(f"SELECT p_partkey, {_DESCRIPTION} || {_INFO} || {_ASK} AS prompt FROM part")
def prompt_zero_shot(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select("p_partkey", Prompts(TASK).zero_shot(MC).alias("prompt"))


@query(f"""SELECT p_partkey, 'Look.' || chr(10) || chr(10) || 'Information:' || chr(10) || 'size = ' || CASE WHEN p_size < 10 THEN 'small' ELSE 'large' END || ', brand = ' || p_brand || ', type = ' || p_type || chr(10) || chr(10) || 'Answer: Go.' AS comma,
  {_DESCRIPTION} || 'Information:' || chr(10) || 'The brand: ' || p_brand || '. The type: ' || p_type || '. The size: ' || {_SIZE} || '.' || chr(10) || chr(10) || 'Question: What is the probability that the part is expensive?' || chr(10) || 'Answer (between 0 and 1): 0.' AS text FROM part""")
def prompt_variations(spark: SparkSession, d: str) -> DataFrame:
    low = {"p_size": lambda x: F.when(x < 10, "small").otherwise("large")}
    a = Prompts(TASK, PromptConfig.from_dict({"format": "comma", "connector": "=", "granularity": "low", "order": "p_size", "custom_prompt_prefix": "Look.", "custom_prompt_suffix": " Go.", "show_question": False}), low)
    b = Prompts(TASK, PromptConfig.from_dict({"format": "text", "connector": ":"}))
    return _parts(spark, d).select("p_partkey", a.zero_shot(MC, None).alias("comma"), b.zero_shot(NUM).alias("text"))


@query(f"""WITH e AS (SELECT *, row_number() OVER (ORDER BY p_partkey) AS shot FROM part WHERE p_partkey IN (SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 3)),
  h AS (SELECT string_agg(CASE WHEN shot = 2 THEN {_DESCRIPTION} ELSE '' END || {_INFO} || {_ASK} || ' ' || CASE WHEN p_retailprice > 1000 THEN 'B' ELSE 'A' END || chr(10) || chr(10), '' ORDER BY CASE shot WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END) AS head FROM e)
  SELECT p_partkey, head || {_INFO} || {_ASK} AS prompt FROM part, h""")
def few_shot_cross(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = _parts(spark, d)
    examples = rows.orderBy("p_partkey").limit(3).withColumn("shot", F.row_number().over(Window.orderBy("p_partkey")))
    return Prompts(TASK).few_shot(rows, examples, MC, order=(1, 2, 0)).select("p_partkey", "prompt")


@query(f"""SELECT p_partkey, '<|system|>Be brief.<|end|><|user|>' || {_DESCRIPTION} || {_INFO} || chr(10) || chr(10) || 'Question: Is the part expensive?' || chr(10) || 'A. No.' || chr(10) || 'B. Yes.<|end|><|assistant|>My answer is' AS prompt FROM part""")
def prompt_chat(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).select("p_partkey", Prompts(TASK).chat(MC, system="Be brief.", prefill="My answer is", template=ChatTemplate()).alias("prompt"))


@query("SELECT conv_id, string_agg('<|' || role || '|>' || text || '<|end|>', '' ORDER BY turn, role, text) AS chat FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def chat_template_rows(spark: SparkSession, d: str) -> DataFrame:
    listed = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    out = listed.select("conv_id", ChatTemplate(takes_system=False).messages(F.col("m")).alias("chat"))
    return out.where("chat <> ''")


@query("SELECT p_partkey, order_id, CASE WHEN (p_retailprice > 1000) = (order_id = 0) THEN 'B' ELSE 'A' END AS answer_key, length(q) AS size FROM part, (SELECT 0 AS order_id, 'Question: Is the part expensive?' || chr(10) || 'A. No.' || chr(10) || 'B. Yes.' || chr(10) || 'Answer:' AS q UNION ALL SELECT 1, 'Question: Is the part expensive?' || chr(10) || 'A. Yes.' || chr(10) || 'B. No.' || chr(10) || 'Answer:')")
def permutation_explode(spark: SparkSession, d: str) -> DataFrame:
    rows = inference.in_each_order(_parts(spark, d), MC, lambda q: F.concat(q.key_of(F.col("`p_retailprice>1000`")), F.lit(q.prompt())))
    return rows.select("p_partkey", "order_id", F.substring("prompt", 1, 1).alias("answer_key"), (F.length("prompt") - 1).alias("size"))


@query("SELECT p_partkey, CASE WHEN p_retailprice > 1000 THEN 'B' ELSE 'A' END AS answer_key, CASE p_partkey % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' END AS answer FROM part")
def answer_key_map(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("p_partkey") % 3 == 0, " a ").when(F.col("p_partkey") % 3 == 1, "B").otherwise("C")
    return _parts(spark, d).select("p_partkey", MC.key_of(F.col("`p_retailprice>1000`")).alias("answer_key"), MC.text_of_answer(said).alias("answer"))


_TEXTS = """x AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '<think>maybe 3%</think> Probability: ' || CAST(event_id % 101 AS VARCHAR) || '%' WHEN 1 THEN 'First 12%, then Probability is ' || CAST(event_id % 97 AS VARCHAR) || '.5%' WHEN 2 THEN 'About ' || CAST(event_id % 120 AS VARCHAR) || ' % in all'
  WHEN 3 THEN 'no idea' WHEN 4 THEN '</think> half </think> 40%' ELSE 'Probability: 150%' END AS text FROM events)"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    s = lambda c: c.cast("string")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("<think>maybe 3%</think> Probability: "), s(k % 101), F.lit("%")))
        .when(k % 6 == 1, F.concat(F.lit("First 12%, then Probability is "), s(k % 97), F.lit(".5%")))
        .when(k % 6 == 2, F.concat(F.lit("About "), s(k % 120), F.lit(" % in all")))
        .when(k % 6 == 3, "no idea").when(k % 6 == 4, "</think> half </think> 40%").otherwise("Probability: 150%")
    )
    return table(spark, d, "events").select("event_id", text.alias("text"))


@query(f"WITH {_TEXTS} SELECT event_id, CASE WHEN instr(text, '</think>') > 0 THEN trim(substr(text, instr(text, '</think>') + 8)) ELSE text END AS answer FROM x")
def think_strip(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("event_id", t.after_thinking(F.col("text")).alias("answer"))


@query(f"""WITH {_TEXTS}, y AS (SELECT event_id, TRY_CAST(regexp_extract_all(text, '(\\d+(?:\\.\\d+)?)\\s*%', 1)[-1] AS DOUBLE) AS v FROM x) SELECT event_id, CASE WHEN v/100 BETWEEN 0 AND 1 THEN round(v/100, 6) END AS probability FROM y""")
def cot_extract_percent(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_texts(spark, d).select("event_id", t.last_probability(F.col("text"), *t.PROBABILITY_PATTERNS[2]).alias("probability")), "probability")


@query()
def cot_extract_full(spark: SparkSession, d: str) -> DataFrame:
    """Some of its patterns look around, which DuckDB's can't."""
    return _texts(spark, d).select("event_id", t.probability(t.after_thinking(F.col("text"))).alias("probability"), t.probability_or_half(F.col("text")).alias("risk_score"))


@query(f"WITH {_TEXTS}, y AS (SELECT TRY_CAST(regexp_extract_all(text, '(\\d+(?:\\.\\d+)?)\\s*%', 1)[-1] AS DOUBLE) AS v FROM x) SELECT count(*) AS n, count(*) FILTER (v IS NULL OR v > 100) AS n_failed, round(count(*) FILTER (v IS NULL OR v > 100) / count(*), 6) AS failure_rate, count(*) FILTER (v IS NULL OR v > 100) >= 0.25e0 * count(*) AS warned FROM y")
def cot_failure_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).select(t.last_probability(F.col("text"), *t.PROBABILITY_PATTERNS[2]).alias("p"))
    return rounded(inference.failure_rate(rows, "p"), "failure_rate")


_SOFT = "l AS (SELECT vec_id, unnest(list_transform(embedding, lambda v: 10e0*v)) AS z, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), s AS (SELECT vec_id, i, exp(z - max(z) OVER w) / sum(exp(z - m)) OVER w AS p FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM l) WINDOW w AS (PARTITION BY vec_id)), k AS (SELECT vec_id, i, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) AS r FROM s)"


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    logits = F.transform("embedding", lambda v: v.cast("double") * 10.0)
    soft = table(spark, d, "embeddings").select("vec_id", decode.softmax(logits).alias("p"))
    return soft.select("vec_id", "p", decode.top_k(F.col("p"), 20).alias("tokens"))


@query(f"WITH {_SOFT} SELECT vec_id, i::INT AS token, round(p, 6) AS p FROM k WHERE r <= 5")
def topk_logprobs(spark: SparkSession, d: str) -> DataFrame:
    top = _tokens(spark, d).select("vec_id", F.explode(decode.top_k(F.col("p"), 5)).alias("token", "p"))
    return rounded(top, "p")


#: Keys with and without a blank, and what isn't a key.
_VOCABULARY = {" A": 1, " B": 2, "A": 11, "B": 12, "x": 3}


@query(f"""WITH {_SOFT}, t AS (SELECT * FROM k WHERE r <= 20 AND i < 40), m AS (SELECT vec_id, coalesce(max(p) FILTER (i=1),0) AS a1, coalesce(max(p) FILTER (i=2),0) AS b1, coalesce(max(p) FILTER (i=11),0) AS a0, coalesce(max(p) FILTER (i=12),0) AS b0 FROM t GROUP BY 1)
  SELECT vec_id, round(CASE WHEN greatest(a0+b0, a1+b1) <= 0 THEN 0.5e0 WHEN a0+b0 >= a1+b1 THEN b0/(a0+b0) ELSE b1/(a1+b1) END, 6) AS risk_score FROM m""")
def mc_decode(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = F.create_map(*[F.lit(v) for kv in _VOCABULARY.items() for v in kv])
    return rounded(_tokens(spark, d).select("vec_id", decode.multiple_choice(decode.in_range(F.col("tokens"), 40), vocabulary, MC).alias("risk_score")), "risk_score")


@query(f"""WITH {_SOFT}, f AS (SELECT vec_id, min_by(i, struct_pack(m := -p, i := i)) FILTER (i < 10) AS d1, min_by(i, struct_pack(m := -p, i := i)) FILTER (i BETWEEN 10 AND 19) - 10 AS d2 FROM s GROUP BY 1)
  SELECT vec_id, round(CAST('0.' || CAST(d1 AS VARCHAR) || CAST(d2 AS VARCHAR) AS DOUBLE), 6) AS risk_score FROM f""")
def numeric_decode(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = F.create_map(*[F.lit(v) for i in range(10) for v in (str(i), i)], F.lit("word"), F.lit(30))
    rows = _tokens(spark, d).select("vec_id", F.array(decode.top_k(F.slice("p", 1, 10), 10), decode.top_k(F.slice("p", 11, 10), 10)).alias("passes"))
    return rounded(rows.select("vec_id", decode.numeric(F.col("passes"), vocabulary, 40).alias("risk_score")), "risk_score")


@query("""SELECT conv_id, array_to_string(list_sort(list_distinct(flatten(list([role, CAST(turn AS VARCHAR)])))), ',') AS vocabulary FROM conversations GROUP BY 1""")
def synthetic_vocab(spark: SparkSession, d: str) -> DataFrame:
    one = F.create_map("role", F.lit(0.5), F.col("turn").cast("string"), F.lit(0.5))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(one).alias("m"))
    return rows.select("conv_id", F.array_join(decode.synthetic_vocabulary(F.col("m")), ",").alias("vocabulary"))


@query("""WITH x AS (SELECT event_id, value / 1000 AS decoded, CASE event_id % 3 WHEN 0 THEN '55' WHEN 1 THEN '0.25 or so' ELSE 'none' END AS said FROM events), y AS (SELECT *, nullif(regexp_extract(said, '^([-+]?\\d*\\.\\d+|\\d+)', 1), '') AS n FROM x), z AS (SELECT *, CASE WHEN contains(n, '.') THEN CAST(n AS DOUBLE) ELSE CAST('0.' || n AS DOUBLE) END AS s FROM y)
  SELECT event_id, round(CASE WHEN s IS NOT NULL AND abs(decoded - s) > 0.01e0 + 1e-5 * abs(s) THEN s ELSE decoded END, 6) AS risk_score FROM z""")
def web_override(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    said = F.when(k % 3 == 0, "55").when(k % 3 == 1, "0.25 or so").otherwise("none")
    rows = table(spark, d, "events").select("event_id", (F.col("value") / 1000).alias("decoded"), said.alias("said"))
    return rounded(rows.select("event_id", t.reconciled(F.col("decoded"), t.stated_probability(F.col("said"))).alias("risk_score")), "risk_score")


@query("SELECT p_partkey AS row_id, round(avg(greatest(0e0, least(1e0, p_size/50e0 * 1.3e0 - 0.1e0*o))), 6) AS risk_score FROM part, (SELECT unnest([0, 1]) AS o) GROUP BY 1")
def order_bias_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("o"), "p_size")
    return rounded(inference.averaged(rows.withColumn("risk_score", F.col("p_size") / 50.0 * 1.3 - 0.1 * F.col("o"))), "risk_score")


@query(f"""SELECT p_partkey AS row_id, (CAST('0x' || substr(md5({_DESCRIPTION} || {_INFO} || {_ASK}), 1, 8) AS BIGINT) % 10000) / 10000e0 AS risk_score FROM part""")
def batch_score_stub(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d).select(F.col("p_partkey").alias("row_id"), Prompts(TASK).zero_shot(MC).alias("prompt"))
    return inference.scored(rows, inference.HashBackend).select("row_id", "risk_score")


@query("""WITH p AS (SELECT 'Brand ' || p_brand || ' of size ' || CAST(p_size AS VARCHAR) AS prompt FROM part)
  SELECT prompt, count(*) AS n_rows, 1::BIGINT AS n_asked, (CAST('0x' || substr(md5(prompt), 1, 8) AS BIGINT) % 10000) / 10000e0 AS risk_score FROM p GROUP BY prompt""")
def stored_answers(spark: SparkSession, d: str) -> DataFrame:
    """Prompts that many parts share, asked by two runs of which the second has what the first had and more: each prompt is asked once."""
    from ..sources.answers import NUMBERS, AnswerStore, answer_key
    from ..sources.shared import shared_folder

    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit("Brand "), "p_brand", F.lit(" of size "), F.col("p_size").cast("string")).alias("prompt"))
    store = AnswerStore(f"{shared_folder(spark)}/stored-answers-{uuid.uuid4().hex[:12]}")
    store.answered(rows.where("p_partkey % 2 = 0"), inference.HashBackend, model_name="hash")
    found = store.answered(rows, inference.HashBackend, model_name="hash").groupBy("prompt").agg(F.count(F.lit(1)).alias("n_rows"), F.max("answer").alias("risk_score"))
    asked = store.batches(spark, NUMBERS).groupBy("_key").agg(F.count(F.lit(1)).alias("n_asked"))
    return found.join(asked, answer_key(F.col("prompt"), "hash", {}) == F.col("_key")).select("prompt", "n_rows", "n_asked", "risk_score")


@query(f"""SELECT p_partkey AS id, regexp_replace(substr({_INFO}, 14), '[.]$', '') AS description, 'No|Yes' AS choices, CASE WHEN p_retailprice > 1000 THEN 'Yes' ELSE 'No' END AS answer, CASE WHEN p_retailprice > 1000 THEN 'B' ELSE 'A' END AS answer_key, CAST(p_retailprice > 1000 AS INT) AS label FROM part""")
def qa_dataset_export(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tables import qa_dataset

    rows = _parts(spark, d).withColumn("row_id", F.col("p_partkey"))
    out = qa_dataset(rows, Prompts(TASK), MC, NUM, "`p_retailprice>1000`")
    return out.select("id", F.regexp_replace("description", "[.]$", "").alias("description"), F.array_join("choices", "|").alias("choices"), "answer", "answer_key", "label")


@query(f"SELECT p_partkey, '- The brand is: ' || p_brand || '.' || chr(10) || '- The type is: ' || p_type || '.' || chr(10) || '- The size is: ' || {_SIZE} || '.' AS description FROM part")
def legacy_description(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.prompt import description_list

    return _parts(spark, d).select("p_partkey", description_list(TASK).alias("description"))


def _number(prompt: str) -> int:
    return int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16) % 10000


class _Tokens:
    """Stands in for a local model: what it gives is made from the prompt's MD5."""

    def __init__(self, settings):
        self.settings = settings

    def __call__(self, prompts):
        if not self.settings.digits_only:
            return [[{1: _number(p) / 20000, 2: 0.5 - _number(p) / 20000, 7: 0.3, 999: 0.2}] for p in prompts]
        return [[{10 + _number(p) // 10 % 10: 0.9, 3: 0.1}, {10 + _number(p) % 10: 0.8, 12: 0.1}] for p in prompts]


class _Words:
    """Stands in for a web service; every third answer states another number than its tokens do."""

    def __init__(self, settings):
        pass

    def __call__(self, prompts):
        out = []
        for n in (_number(p) % 100 for p in prompts):
            out.append((f"0.{(n + 40) % 100:02d} I think" if n % 3 == 0 else f"{n:02d}", [{str(n // 10): 0.9, "so": 0.1}, {str(n % 10): 0.8, "x": 0.05}]))
        return out


class _Text:
    """Stands in for a model that reasons; every fifth text states nothing."""

    def __init__(self, settings):
        pass

    def __call__(self, prompts):
        return [f"Prices rise by 5%. Probability: {n}%" if n % 5 else "Hard to say." for n in (_number(p) % 100 for p in prompts)]


def _benchmark(spark: SparkSession, d: str, model: inference.Model, **config) -> tuple[Benchmark, DataFrame]:
    data = table(spark, d, "part").withColumn("row_id", F.col("p_partkey"))
    b = Benchmark(TASK, data, model, Config(**config))
    return b, b.data


_IDS = {" A": 1, " B": 2, "x": 7} | {str(i): 10 + i for i in range(10)}
_MC_PROMPT = f"{_DESCRIPTION} || {_INFO} || chr(10) || chr(10) || 'Question: Is the part expensive?' || chr(10) || 'A. {{}}.' || chr(10) || 'B. {{}}.' || chr(10) || 'Answer:'"
_NUM_PROMPT = f"{_DESCRIPTION} || {_INFO} || chr(10) || chr(10) || 'Question: What is the probability that the part is expensive?' || chr(10) || 'Answer (between 0 and 1): 0.'"


@query(f"WITH x AS (SELECT p_partkey, {HASH32.format(_MC_PROMPT.format('No', 'Yes'))} % 10000 AS a, {HASH32.format(_MC_PROMPT.format('Yes', 'No'))} % 10000 AS b FROM part) SELECT p_partkey AS row_id, round(((1 - a/10000e0) + b/10000e0) / 2, 6) AS risk_score FROM x")
def model_multiple_choice(spark: SparkSession, d: str) -> DataFrame:
    """Prompts in both orders, token probabilities, decoding and the mean, as one run has them."""
    b, rows = _benchmark(spark, d, inference.Model(_Tokens, "tokens", _IDS, 100))
    return rounded(b.scored(rows), "risk_score")


@query(f"SELECT p_partkey AS row_id, round(({HASH32.format(_NUM_PROMPT)} % 100) / 100e0, 6) AS risk_score FROM part")
def model_numeric(spark: SparkSession, d: str) -> DataFrame:
    b, rows = _benchmark(spark, d, inference.Model(_Tokens, "tokens", _IDS, 100), numeric_risk_prompting=True)
    return rounded(b.scored(rows), "risk_score")


@query(f"WITH x AS (SELECT p_partkey, {HASH32.format(_NUM_PROMPT)} % 100 AS n FROM part) SELECT p_partkey AS row_id, round(CASE WHEN n % 3 = 0 THEN (n + 40) % 100 ELSE n END / 100e0, 6) AS risk_score FROM x")
def model_web(spark: SparkSession, d: str) -> DataFrame:
    """Digits of the answer's tokens, but for a stated number that clearly differs."""
    b, rows = _benchmark(spark, d, inference.Model(_Words, "words"), numeric_risk_prompting=True)
    return rounded(b.scored(rows), "risk_score")


_REASON = """'Question: What is the probability that the part is expensive?' || chr(10) || chr(10) || 'Think step-by-step about the factors that could influence the answer to this question. After reasoning through the relevant information, provide your final probability estimate.'
  || chr(10) || chr(10) || 'Your response MUST end with your probability estimate in the following format:' || chr(10) || 'Probability: X%' || chr(10) || 'where X is a number between 0 and 100.' || chr(10) || chr(10) || 'Reasoning:'"""


@query(f"WITH x AS (SELECT p_partkey, {HASH32.format(f'{_DESCRIPTION} || {_INFO} || chr(10) || chr(10) || {_REASON}')} % 100 AS n FROM part) SELECT p_partkey AS row_id, round(CASE WHEN n % 5 = 0 THEN 0.5e0 ELSE n / 100e0 END, 6) AS risk_score FROM x")
def model_reasoning(spark: SparkSession, d: str) -> DataFrame:
    b, rows = _benchmark(spark, d, inference.Model(_Text, "text"), cot_prompting=True)
    return rounded(b.scored(rows), "risk_score")


_HASH60 = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"


@query(f"""WITH t AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(p_partkey AS VARCHAR) || ':42'), p_partkey) AS p FROM part), n AS (SELECT count(*) AS n FROM part),
  j AS (SELECT p_partkey AS k, j, {_HASH60.format("CAST(p_partkey AS VARCHAR) || ':42:0:' || CAST(j AS VARCHAR)")} % n + 1 AS p FROM part, n, range(15) r(j)),
  u AS (SELECT k, p, min(j) AS j FROM j GROUP BY 1, 2), w AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY j) AS r FROM u),
  s AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY md5(CAST(k AS VARCHAR) || ':42:0:' || CAST(p AS VARCHAR))) AS shot FROM w WHERE r <= 3),
  h AS (SELECT k, string_agg(CASE WHEN shot = 1 THEN {_DESCRIPTION} ELSE '' END || {_INFO} || {_ASK} || ' ' || CASE WHEN p_retailprice > 1000 THEN 'B' ELSE 'A' END || chr(10) || chr(10), '' ORDER BY shot) AS head FROM s JOIN t USING (p) GROUP BY k)
  SELECT p_partkey, md5(head || {_INFO} || {_ASK}) AS digest FROM part JOIN h ON p_partkey = k""")
def few_shot_fresh(spark: SparkSession, d: str) -> DataFrame:
    """Three examples drawn anew for each row."""
    rows = _parts(spark, d).withColumn("row_id", F.col("p_partkey"))
    return Prompts(TASK).few_shot_each(rows, rows, MC, shots=3).select("p_partkey", F.md5("prompt").alias("digest"))


@query(f"WITH {_SOFT} SELECT vec_id, i::INT AS token, round(exp(ln(p)), 6) AS p FROM k WHERE r <= 5")
def pass_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Log-probabilities of tokens by position, as engines return them, to probabilities."""
    top = _tokens(spark, d).select("vec_id", decode.top_k(F.col("p"), 5).alias("m"))
    positions = F.array(F.transform_values("m", lambda _, p: F.struct(F.log(p).alias("logprob"))))
    return rounded(top.select("vec_id", F.explode(F.get(decode.passes_of(positions), F.lit(0))).alias("token", "p")), "p")


@query(f"WITH {SCORES} SELECT row_id, round(1 - risk_score, 6) AS no, round(risk_score, 6) AS yes FROM scores")
def class_probabilities(spark: SparkSession, d: str) -> DataFrame:
    both = scores(spark, d).select("row_id", both_classes(F.col("risk_score")).alias("p"))
    return rounded(both.select("row_id", F.get("p", F.lit(0)).alias("no"), positive_class(F.col("p")).alias("yes")), "no", "yes")
