"""Queries that write a test table in some format and read it back, and SQL text exports."""

from pyspark.sql import functions as F

from ..operators.topk import union_by_name
from ..session import scratch_path
from ..sources import catalog, exporters, readers
from .registry import query, table
from .steps import run_cleaning


@query("scan_parquet", """
select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_quantity > 45""")
def scan_parquet(spark, folder):
    return readers.read_parquet(spark, f"{folder}/lineitem.parquet").filter("l_quantity > 45").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("scan_csv", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def scan_csv(spark, folder):
    path = scratch_path(spark, "csv")
    table(spark, folder, "customer").repartition(4).write.csv(path, header=True)
    return readers.read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("scan_json_records", "select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier")
def scan_json_records(spark, folder):
    path = scratch_path(spark, "json")
    table(spark, folder, "supplier").repartition(4).write.json(path)
    return readers.read_json(spark, path, lines=True)


def _write_text(df, spark, name):
    path = scratch_path(spark, name)
    df.write.text(path)
    return path


@query("json_union_lists", """
select n_nationkey::bigint as key, n_name as name, n_regionkey::bigint as region from nation
union all select r_regionkey, r_name, null from region""")
def json_union_lists(spark, folder):
    """One object per partition file, holding a list of nations and a list of regions."""
    record = "struct({0}key as key, {1}_name as name, {2} as region)"
    both = table(spark, folder, "nation").selectExpr(
        "'n' as kind", record.format("n_nation", "n", "n_regionkey") + " as r").unionAll(
        table(spark, folder, "region").selectExpr(
            "'r' as kind", record.format("r_region", "r", "cast(null as int)") + " as r"))
    lists = both.agg(F.collect_list(F.when(F.col("kind") == "n", F.col("r"))).alias("nations"),
                     F.collect_list(F.when(F.col("kind") == "r", F.col("r"))).alias("regions"))
    text = lists.select(F.to_json(F.struct("nations", "regions")).alias("value"))
    return readers.read_json(spark, _write_text(text, spark, "lists"))


@query("json_flatten", """
select o_orderkey, o_custkey as "customer.id", o_totalprice as "amount.gross.value",
  o_orderpriority as "amount.priority" from orders""")
def json_flatten(spark, folder):
    nested = table(spark, folder, "orders").select(
        "o_orderkey", F.struct(F.col("o_custkey").alias("id")).alias("customer"),
        F.struct(F.struct(F.col("o_totalprice").alias("value")).alias("gross"),
                 F.col("o_orderpriority").alias("priority")).alias("amount"))
    path = scratch_path(spark, "nested")
    nested.write.json(path)
    return readers.flatten(readers.read_json(spark, path, lines=True))


@query("scan_xml", """
select s_suppkey::varchar as s_suppkey, s_name, s_nationkey::varchar as s_nationkey from supplier""")
def scan_xml(spark, folder):
    path = scratch_path(spark, "xml")
    (table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey")
     .write.format("xml").option("rootTag", "suppliers").option("rowTag", "supplier").save(path))
    return readers.read_xml(spark, path)


def _mixed_folder(spark, folder):
    """A folder of folders with the same tables in several formats and JSON shapes, and files that are broken or of no known type."""
    base = scratch_path(spark, "mixed")
    customer, supplier = table(spark, folder, "customer"), table(spark, folder, "supplier")
    customer.repartition(3).write.csv(f"{base}/customers", header=True)
    customer.repartition(2).write.parquet(f"{base}/columnar")
    supplier.repartition(1).write.json(f"{base}/suppliers")
    supplier.repartition(1).write.format("xml").option("rowTag", "supplier").option("rootTag", "all").save(f"{base}/xml")
    table(spark, folder, "nation").select("n_name").repartition(1).write.text(f"{base}/plain")
    region = table(spark, folder, "region").agg(F.collect_list(F.struct("r_regionkey", "r_name")).alias("regions"))
    nation = table(spark, folder, "nation").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    region.select(F.to_json("regions")).repartition(1).write.text(f"{base}/list")
    both = region.join(nation)  # one row each
    both.select(F.to_json(F.struct("regions", "nations"))).repartition(1).write.text(f"{base}/lists")
    both.select(F.to_json(F.struct(F.struct(F.size("regions").alias("n")).alias("region")))).repartition(1).write.text(f"{base}/object")
    both.select(F.lit('{"broken": [1, 2')).repartition(1).write.text(f"{base}/broken")
    both.select(F.lit("PAR1 and no more")).repartition(1).write.text(f"{base}/cut")
    return base


@query("file_catalog", """
select 'csv' as type, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' as shape, 3::bigint as files, 0::bigint as broken
union all select 'json', 'lines', 1, 0 union all select 'json', 'list', 1, 0 union all select 'json', 'lists', 1, 0
union all select 'json', 'object', 1, 0 union all select 'json', null, 1, 1
union all select 'parquet', 'some columns', 2, 0 union all select 'parquet', null, 1, 1
union all select 'unknown', null, 1, 0 union all select 'xml', 'supplier', 1, 0""")
def file_catalog(spark, folder):
    found = catalog.file_catalog(spark, _mixed_folder(spark, folder)).filter("length > 0 and extension <> 'crc'")
    shape = F.when((F.col("type") == "parquet") & F.col("shape").startswith("c_custkey"), "some columns").otherwise(F.col("shape"))
    return found.groupBy("type", shape.alias("shape")).agg(
        F.count(F.lit(1)).alias("files"), F.count("error").alias("broken"))


@query("batch_ingest_report", """
select 'csv' as type, 'ok' as status, 3::bigint as files, count(*)::bigint as n_rows from customer
union all select 'parquet', 'ok', 2, count(*) from customer
union all select 'parquet', 'failed', 1, 0
union all select 'xml', 'ok', 1, count(*) from supplier
union all select 'json', 'ok', 4, (select count(*) from supplier) + 2 * (select count(*) from region) + (select count(*) from nation) + 1
union all select 'json', 'failed', 1, 0
union all select 'unknown', 'failed', 1, 0""")
def batch_ingest_report(spark, folder):
    base = _mixed_folder(spark, folder)
    _, report = catalog.batch_ingest(spark, base)
    report = report.filter(~F.col("file").rlike("_SUCCESS$|[.]crc$"))
    return report.groupBy("type", "status").agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n_rows"))


@query("insert_statements", """
with r as (select (row_number() over (order by c_custkey) - 1) // 1000 as batch_id, c_custkey,
  '(' || c_custkey || ', ''' || replace(c_name, '''', '''''') || ''', ' || case when c_custkey % 7 = 0 then 'NULL'
  else c_acctbal::varchar end || ', ' || case when c_nationkey > 10 then 'TRUE' else 'FALSE' end || ')' as v from customer)
select batch_id::bigint as batch_id, 'INSERT INTO customer (c_custkey, c_name, c_acctbal, far) VALUES' || chr(10)
  || '  ' || string_agg(v, ',' || chr(10) || '  ' order by c_custkey) || ';' as sql from r group by 1""")
def insert_statements(spark, folder):
    raw = table(spark, folder, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        (F.col("c_nationkey") > 10).alias("far"))
    return exporters.insert_statements(raw, "customer", ["c_custkey"])


@query("insert_parameterized", """
with r as (select (row_number() over (order by s_suppkey) - 1) // 40 as batch_id, * from supplier)
select batch_id::bigint as batch_id, 'INSERT INTO supplier (s_suppkey, s_name) VALUES '
  || string_agg('(%s, %s)', ', ') || ';' as sql,
  string_agg(s_suppkey || '|' || s_name, '|' order by s_suppkey) as params from r group by 1""")
def insert_parameterized(spark, folder):
    out = exporters.insert_statements(table(spark, folder, "supplier"), "supplier", ["s_suppkey"],
                                      ["s_suppkey", "s_name"], 40, parameterized=True)
    return out.withColumn("params", F.array_join("params", "|"))


@query("bulk_copy_rows", '''
select p_partkey || ',"' || p_name || ', ""new""",' || p_brand || ',' ||
  case when p_partkey % 5 = 0 then '\\N' else p_size::varchar end as line from part''')
def bulk_copy_rows(spark, folder):
    raw = table(spark, folder, "part").select(
        "p_partkey", F.concat("p_name", F.lit(', "new"')).alias("p_name"), "p_brand",
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("p_size"))
    return exporters.copy_rows(raw)


@query("run_cleaning", """
with b as (select c_custkey as cust_key, c_mktsegment as segment,
  case when c_custkey % 6 = 0 then null else c_acctbal end as bal from customer)
select cust_key, segment, round(coalesce(bal, (select avg(bal) from b)), 4) as bal from b""")
def run_cleaning_file(spark, folder):
    path = scratch_path(spark, "dirty")
    raw = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("CustKey"), F.col("c_mktsegment").alias("Segment"),
        F.when(F.col("c_custkey") % 6 != 0, F.col("c_acctbal")).alias("Bal"),
        F.col("c_name").alias("Dropped"))
    union_by_name([raw, raw.filter("CustKey % 4 = 0")]).write.csv(path, header=True)
    out = run_cleaning(spark, path, "csv", drop_duplicates=True, fillna="mean",
                       columns="CustKey, Segment, Bal")
    return out.withColumns({"bal": F.round("bal", 4), "cust_key": F.col("cust_key").cast("bigint")})
