"""Derived tables: claims, mentions, people and the like out of the star schema and the documents.

Each is one SELECT that Spark and DuckDB both read; {name} stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from attestor.sources.shared import parted

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOURCES = "slack gmail linear google_drive hubspot fireflies github jira confluence".split()


def _pick(number: str, names) -> str:
    return f"case {number} % {len(names)} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(names)) + " end"


_DOMAINS = ["redwood.com", "redwood.ai", "redwood-inference.com", "acme.io"]

VIEWS = {
    "v_doc": f"select doc_id as id, {_pick('doc_id', SOURCES)} as source_type, concat(lang, ' ', source) as title, text as body from {{documents}}",
    # the predicate's spelling and the source do not hang together
    "v_claim": f"""select o_orderkey as claim_id, o_orderkey as dsid, {_pick('o_orderkey', SOURCES)} as source_type, c_name as subject,
      {_pick('cast(floor(o_orderkey / 3) as bigint)', ['has status', 'status', 'state', 'the current status of', 'frobnicates', 'includes'])} as predicate, o_orderstatus as object,
      cast(0.9 as double) as confidence, concat(case when o_orderkey % 7 = 0 then 'They said ' else '' end, c_name, ' is ', o_orderstatus, ' ', cast(o_orderkey % 5 as string)) as quote,
      case when o_orderkey % 4 = 0 then null else cast(floor(epoch_of) as bigint) end as timestamp
      from (select o_orderkey, o_custkey, o_orderstatus, {{epoch}} as epoch_of from {{orders}}) o join {{customer}} c on o.o_custkey = c.c_custkey""",
    "v_mention": "select l_orderkey * 8 + l_linenumber as mention_id, l_orderkey as dsid, min(l_suppkey) as entity, min(l_partkey) as channel from {lineitem} group by l_orderkey, l_linenumber",
    "v_reference": "select distinct l_orderkey as dsid, l_partkey as ticket from {lineitem}",
    "v_person": f"""select p_partkey as person_id, p_name as name, concat(replace(p_name, ' ', '.'), '@', {_pick('p_partkey', _DOMAINS)}) as email from {{part}}""",
    "v_question": "select item_id as qid, text from {benchmark}",
}

#: Tables that a view groups row by row, and by what: large ones are dealt out by it first.
GROUPED = {"v_mention": ("lineitem", ["l_orderkey", "l_linenumber"])}


def text(name: str, engine: str) -> str:
    """A view's SELECT with other views put in; tables stay as {{name}} for Spark and become names for DuckDB."""
    epoch = "unix_timestamp(o_orderdate)" if engine == "spark" else "epoch(o_orderdate)"

    def put(m: re.Match) -> str:
        k = m[1]
        if k == "epoch":
            return epoch
        if k in VIEWS:
            return f"({text(k, engine)})"
        return "{" + k + "}" if engine == "spark" else k

    return re.sub(r"\{(\w+)\}", put, VIEWS[name])


def duck(name: str) -> str:
    """A view as a DuckDB subquery."""
    return f"({text(name, 'duck')})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = text(name, "spark")
    used = {t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", sql))}
    if name in GROUPED:
        t, keys = GROUPED[name]
        used[t] = parted(used[t], used[t].count(), *keys)  # a count of Parquet reads the footers alone
    return spark.sql(sql, **used)
