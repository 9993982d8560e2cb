"""Queries that run the commands, prompt templates and model calls."""

from __future__ import annotations

import contextlib
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import cli, shared
from skein.functions import answers
from skein.plans.derived import table
from skein.plans.files import _PAGES_SQL, export
from skein.plans.registry import query
from skein.sources import archive


@query(f"""
with {_PAGES_SQL}, n as (select count(*) as n from p where ns = '0' and not is_redirect and not blank)
select unnest(['parse-wiki', 'chunk', 'embed', 'store', 'store again', 'build-bm25', 'stats-db', 'db-health', 'show-chunk', 'retrieve', 'delete-chunk', 'ingest', 'ingest again', 'purge-db', 'db-health after']) as step,
  unnest([n || ' articles', 3 * n || ' chunks', (3 * n)::varchar, 'add ' || n, 'skip ' || n, (3 * n)::varchar, n::varchar, 'healthy ' || 3 * n, '## Infobox: Space Town', '1', 'deleted', 'add ' || n, 'skip ' || n, 3 * n - 1 || ' deleted', 'healthy 0']) as result from n""")
def command_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commands one after another, from an export to an emptied store: what each of them says first."""
    base = shared.scratch(spark, "commands")
    xml = export(spark, sf_dir)
    found: list[tuple[str, str]] = []

    def run(step: str, *arguments: str, read=lambda out: out.split("\n")[0].replace("\t", " ")) -> None:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            cli.dispatch(list(arguments), spark)
        found.append((step, read(out.getvalue())))

    first = lambda out: out.split("\t")[0]
    health = lambda out: "{status} {count}".format(**json.loads(out))
    action = lambda out: " ".join(map(str, next((k, v) for k, v in json.loads(out).items())))
    db, index, size = f"{base}/db", f"{base}/index", ("--dimensions", "16")
    run("parse-wiki", "parse-wiki", xml, f"{base}/articles")
    run("chunk", "chunk", f"{base}/articles", f"{base}/chunks")
    run("embed", "embed", f"{base}/chunks", f"{base}/vectors", *size, read=first)
    run("store", "store", f"{base}/vectors", db, "--index", index)
    run("store again", "store", f"{base}/vectors", db, "--index", index)
    run("build-bm25", "build-bm25", db, "--output", index, read=first)
    run("stats-db", "stats-db", db, read=first)
    run("db-health", "db-health", db, read=health)
    run("show-chunk", "show-chunk", db, "3_0")
    run("retrieve", "retrieve", db, index, "item src1", "--top-k", "3", "--depth", "0", *size, read=first)
    run("delete-chunk", "delete-chunk", db, "3_0", "--force")
    run("ingest", "ingest", f"{base}/articles", f"{base}/db2", *size, read=action)
    run("ingest again", "ingest", f"{base}/articles", f"{base}/db2", *size, read=action)
    run("purge-db", "purge-db", db, "--force")
    run("db-health after", "db-health", db, read=health)
    return spark.createDataFrame(found, "step string, result string")


@query("""
select conv_id, turn, 'You are ' || role || '.' || chr(10) || chr(10) || 'Answer in English, from the given context only, as JSON with answer, personality_reply, sources and smalltalk.' as system,
  'Q: ' || text || ' / C: ' || role || chr(10) as prompt from conversations""")
def prompt_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template file of the shared folder, read once, and the default system prompt with a persona for each role."""
    folder = shared.scratch(spark, "templates")
    archive.write_files(spark.createDataFrame([("user.md", "Q: {question} / C: {chunks}\n")], "name string, raw string"), folder)
    templates = answers.Templates(folder, spark)
    template = templates.load("user.md")
    # braces in a template's place-holders may come in any order
    user = F.replace(F.replace(F.lit(template), F.lit("{chunks}"), F.col("role")), F.lit("{question}"), F.col("text"))
    system = F.replace(F.lit(answers.system_prompt("You are {role}.", "en")), F.lit("{role}"), F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", system.alias("system"), user.alias("prompt"))


@query("""
with c as (select conv_id, turn, text, case when turn % 5 = 4 then 'mystery-1' when role = 'user' then 'gpt-4.1' else 'claude-haiku-4-5' end as model from conversations)
select conv_id, turn, case when turn % 5 <> 4 then left(text, 40) || '!' end as reply, case when turn % 5 <> 4 then length(text) // 4 end::integer as prompt_tokens,
  case when turn % 5 <> 4 then round(length(text) // 4 / 1000.0e0 * case when model = 'gpt-4.1' then 0.002e0 else 0.001e0 end + 7 / 1000.0e0 * case when model = 'gpt-4.1' then 0.008e0 else 0.005e0 end, 8) end as cost_usd,
  case when turn % 5 = 4 then 'unknown model mystery-1' end as error from c""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by model name through two providers (here they echo), with tokens and cost; an unknown model is a row with an error."""
    t = F.col("turn")
    model = F.when(t % 5 == 4, "mystery-1").when(F.col("role") == "user", "gpt-4.1").otherwise("claude-haiku-4-5")

    def router() -> answers.Router:
        echo = lambda system, user, model: (user[:40] + "!", len(user) // 4, 7)
        return answers.Router({"openai": echo, "anthropic": echo}, wait=lambda s: None)

    made = answers.generate(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"), model.alias("model")), router, "system")
    return made.select("conv_id", "turn", "reply", "prompt_tokens", F.round("cost_usd", 8).alias("cost_usd"), "error")


@query("select unnest(['answer', 'personality_reply', 'smalltalk', 'sources']) as property, unnest([false, true, true, false]) as required")
def answer_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = json.loads(json.dumps(answers.json_schema()))
    return spark.createDataFrame([(p, p in schema["required"]) for p in sorted(schema["properties"])], "property string, required boolean")
