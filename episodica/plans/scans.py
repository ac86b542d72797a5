"""Queries of readers and sinks: tables are read by explicit schemas, or written in a source's form and read back as it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from episodica.functions import geometry
from episodica.operators import joins
from episodica.sources import readers, writers
from episodica.sources.files import scratch

from .base import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_ORDERS = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 100000")
def pruned_scan(spark, d):
    """Two columns and a filter reach the scan."""
    return readers.parquet(spark, f"{d}/orders.parquet", _ORDERS, ["o_orderkey", "o_totalprice"]).filter("o_totalprice > 100000")


def _text(df, *columns):
    return df.select(F.to_json(F.struct(*columns)).alias("value"))


@query("select event_id, case when value > 50 then event_type else 'none' end as kind, value, case when value > 50 then 1 else 7 end::bigint as n from events")
def defaulted_lines(spark, d):
    """JSON lines in which fields are missing where the value is small."""
    folder, big = scratch(spark), F.col("value") > 50
    _text(table(spark, d, "events"), "event_id", F.when(big, F.col("event_type")).alias("kind"), "value", F.when(big, 1).alias("n")).write.text(folder)
    return readers.json_lines(spark, folder, StructType.fromDDL("event_id bigint, kind string, value double, n bigint"), {"kind": "none", "n": 7})


@query("select event_id, value from events where event_type = 'purchase'")
def prefiltered_lines(spark, d):
    """Only lines that hold a word are parsed."""
    folder = scratch(spark)
    _text(table(spark, d, "events"), "event_id", "event_type", "value").write.text(folder)
    return readers.prefiltered_json(spark, folder, StructType.fromDDL("event_id bigint, value double"), '"purchase"')


@query("select p_partkey, p_name, p_size::bigint as p_size, p_retailprice from part")
def tabbed(spark, d):
    folder, schema = scratch(spark), StructType.fromDDL("p_partkey bigint, p_name string, p_size bigint, p_retailprice double")
    table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").write.option("sep", "\t").csv(folder)
    return readers.tsv(spark, folder, schema)


@query("select s_nationkey::varchar as task, s_suppkey::varchar as ep, s_acctbal > 0 as ok from supplier where s_acctbal <= 0 or s_suppkey % 4 <> 0")
def nested_outcomes(spark, d):
    """Outcomes as documents, one a task, of maps by task and episode; values that are no booleans go."""
    told = F.when(F.col("s_acctbal") <= 0, "false").otherwise(F.when(F.col("s_suppkey") % 4 == 0, "pending").otherwise("true"))
    x = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("task")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("s_suppkey").cast("string"), told))).alias("eps"))
    folder = scratch(spark)
    _text(x, F.create_map("task", "eps").alias("m")).write.option("maxRecordsPerFile", 1).text(folder)
    found = readers.json_document(spark, folder, StructType.fromDDL("m map<string,map<string,string>>"))
    return readers.outcomes(found, "m")


@query("""with x as (select label as ep, vec_id as frame, 'k' || (vec_id % 3) as name, floor(embedding[1] * 256)::int as r, floor(embedding[2] * 256)::int as c from embeddings)
select 'det' as kind, ep::bigint as ep, frame, name, r, c from x where ep % 2 = 0
union all select 'missing', ep, null, null, null, null from (select distinct ep from x where ep % 2 = 1)""")
def cached_detections(spark, d):
    """A file of detections for each even label, and the labels without one."""
    at = lambda i: F.floor(F.col("embedding")[i].cast("double") * 256).cast("int").cast("string")
    v = table(spark, d, "embeddings").select(F.col("label").cast("bigint").alias("ep"), F.col("vec_id").alias("frame"), F.array(F.concat(F.lit("k"), F.col("vec_id") % 3), at(0), at(1)).alias("det"))
    folder = scratch(spark)
    files = v.filter("ep % 2 = 0").groupBy("ep").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("string"), F.array("det"))))).alias("value"))
    whole = files.collect()  # a row for each label
    from episodica.sources.files import location

    store, base = location(folder)
    store.create_dir(base, recursive=True)
    for r in whole:
        with store.open_output_stream(f"{base}/e{r.ep}.json") as f:
            f.write(r.value.encode())
    found, missing = readers.detection_cache(spark, folder, v.select("ep"))
    return found.select(F.lit("det").alias("kind"), "ep", "frame", "name", "r", "c").unionByName(missing.select(F.lit("missing").alias("kind"), "ep"), allowMissingColumns=True)


@query("""with y as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 as nth, l_quantity::bigint as n, l_extendedprice as v from lineitem),
x as (select *, nth + (nth >= 3)::int as ord from y)
select k, ord::bigint as ord, (sum(n) over (partition by k order by ord) - n)::bigint as offset, bool_and(nth = ord) over (partition by k) as complete, greatest(least(v, 50000), 2000) as v from x""")
def reassembled(spark, d):
    """An order's lines as segments of its quantity, in order, with their values clipped; the number after the third is left out."""
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")) - 1
    x = table(spark, d, "lineitem").withColumn("nth", nth)
    x = x.select(F.col("l_orderkey").alias("k"), (F.col("nth") + (F.col("nth") >= 3).cast("int")).cast("bigint").alias("ord"), F.col("l_quantity").cast("bigint").alias("n"), F.col("l_extendedprice").alias("v"))
    return readers.reassemble(x, ["k"], "ord", "n", clip={"v": (2000.0, 50000.0)}).select("k", "ord", F.col("offset").cast("bigint").alias("offset"), "complete", "v")


@query("select doc_id, lang, case when doc_id % 10 = 0 then 'val' else 'train' end as split from documents")
def routed_records(spark, d):
    """Records in a folder for each split."""
    folder = scratch(spark)
    x = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"))
    writers.by_split(x, folder, ["split"])
    return spark.read.schema("doc_id bigint, lang string, split string").json(folder)


@query("""select 'appended' as step, count(distinct o_custkey)::bigint as n from orders where o_custkey % 2 = 0 union all select 'again', 0
union all select 'rest', count(distinct o_custkey) from orders where o_custkey % 2 = 1 or o_custkey is null union all select 'whole', count(distinct o_custkey) from orders""")
def idempotent_appends(spark, d):
    """Rows are appended once, however often they come."""
    folder, keys = scratch(spark), table(spark, d, "orders").select("o_custkey")
    even = keys.filter("o_custkey % 2 = 0")
    counts = [("appended", writers.append_new(even, folder, ["o_custkey"])), ("again", writers.append_new(even, folder, ["o_custkey"])), ("rest", writers.append_new(keys, folder, ["o_custkey"]))]
    return spark.createDataFrame([*counts, ("whole", spark.read.parquet(folder).count())], "step string, n bigint")


@query("select lower(sha256(text)) as address, any_value(text) is not null as kept, count(*) > 1 as repeated from documents where text is not null group by 1")
def addressed_texts(spark, d):
    """Texts by the digest of their content, each once."""
    folder, x = scratch(spark), table(spark, d, "documents").filter("text is not null").select("text")
    writers.append_content(x, folder, "text")
    writers.append_content(x, folder, "text")
    found = spark.read.parquet(folder).select("address", F.col("text").isNotNull().alias("kept"))
    times = x.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("address")).agg((F.count("*") > 1).alias("repeated"))
    return found.join(times, "address")


@query("""select c_custkey, case when c_acctbal < 0 then 'debt' when c_mktsegment is null then 'segment' when c_nationkey % 7 = 0 then 'nation' end as reason from customer""")
def quarantined(spark, d):
    """Customers with the first reason against them, or none."""
    reasons = {"debt": F.col("c_acctbal") < 0, "segment": F.col("c_mktsegment").isNull(), "nation": F.col("c_nationkey") % 7 == 0}
    good, bad = writers.quarantine(table(spark, d, "customer"), reasons)
    return good.select("c_custkey", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("c_custkey", "reason"))


@query("select 'regions' as part, count(*) as rows from region union all select 'nations', count(*) from nation union all select 'suppliers', count(*) from supplier")
def written_family(spark, d):
    parts = {"regions": table(spark, d, "region"), "nations": table(spark, d, "nation"), "suppliers": table(spark, d, "supplier")}
    return writers.meta_family(scratch(spark), parts).select("part", "rows")


@query("select 'first' as build, 'written' as said union all select 'same', 'written' union all select 'other', 'refused' union all select 'rows', count(*)::varchar from customer")
def guarded_builds(spark, d):
    """A build of another selection is refused, one of the same written again."""
    folder, x = f"{scratch(spark)}/build", table(spark, d, "customer")
    chosen, out = [r.c_mktsegment for r in x.select("c_mktsegment").distinct().collect()], []  # a handful of segments
    for build, selection in (("first", chosen), ("same", chosen[::-1]), ("other", chosen[1:])):
        try:
            writers.guarded(x, folder, selection)
            out.append((build, "written"))
        except ValueError:
            out.append((build, "refused"))
    return spark.createDataFrame([*out, ("rows", str(spark.read.parquet(folder).count()))], "build string, said string")


@query("""select o_orderkey, 'allowed' as side from orders where o_custkey in (select c_custkey from customer where c_acctbal > 0)
union all select c_custkey, 'without' from customer where c_acctbal > 0 and c_custkey not in (select o_custkey from orders where o_custkey is not null)""")
def allowed_keys(spark, d):
    """Orders of customers in credit, and such customers without any."""
    keys = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    own, without = joins.allowed(table(spark, d, "orders"), keys, ["o_custkey"])
    return own.select("o_orderkey", F.lit("allowed").alias("side")).unionByName(without.select(F.col("o_custkey").alias("o_orderkey"), F.lit("without").alias("side")))


@query("""with q as (select vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z, embedding[4]::double as w from embeddings),
n as (select *, sqrt(x * x + y * y + z * z + w * w) as len from q), u as (select vec_id, x / len as x, y / len as y, z / len as z, greatest(least(w / len, 1), -1) as w from n),
s as (select *, case when sqrt(1 - w * w) < 1e-9 then 0 else 2 * acos(w) / sqrt(1 - w * w) end as k from u)
select vec_id, round(x * k, 6) as ax, round(y * k, 6) as ay, round(z * k, 6) as az, round(x * y + y * z + z * w, 6) as dot from s""")
def rotations(spark, d):
    """Unit quaternions as axis-angle vectors, and a dot product of their parts."""
    part = [F.col("embedding")[i].cast("double") for i in range(4)]
    u = table(spark, d, "embeddings").select("vec_id", *[(p / geometry.norm(part)).alias(n) for p, n in zip(part, "xyzw")])
    x, y, z, w = (F.col(c) for c in "xyzw")
    axis = u.select("vec_id", geometry.axis_angle(x, y, z, w).alias("a"), geometry.dot([x, y, z], [y, z, w]).alias("dot"))
    return axis.select("vec_id", *[F.round(F.col("a")[i], 6).alias(n) for i, n in enumerate(("ax", "ay", "az"))], F.round("dot", 6).alias("dot"))
