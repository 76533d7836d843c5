"""The record engine's operators applied to the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fuzzy, identity, scalars
from ..functions import predicates as P
from ..functions import steps as S
from ..operators import exports, graph, importers, publication, records, references, rollups, rules, schema, series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)


def query(sql: str | None = None):
    """Register a function of the tables under its name."""

    def register(function: Callable[[Tables], DataFrame]):
        QUERIES[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def text_list(c) -> F.Column:
    """An array as text, since arrays of two engines compare poorly."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


# Scans, predicates and pages


@query("""select p_partkey, p_name, p_brand, p_size from part
where lower(p_name) like '%ring%' and p_size between 5 and 45 and lower(p_type) = 'small' order by p_partkey offset 1 limit 20""")
def op_query_specs(t):
    conditions = P.every(P.contains_text(F.col("p_name"), "RING"), P.in_range(F.col("p_size"), 5, 45, nan=False), P.equals_text(F.col("p_type"), "Small"))
    return records.page(t.part.where(conditions).select("p_partkey", "p_name", "p_brand", "p_size"), [F.col("p_partkey")], 20, 1)


@query("select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 7")
def op_equals(t):
    return t.orders.where(P.equals(F.col("o_orderkey"), 7)).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("select c_custkey, c_mktsegment from customer where lower(c_mktsegment) = 'machinery'")
def op_equals_text(t):
    return t.customer.where(P.equals_text(F.col("c_mktsegment"), "MachinERY")).select("c_custkey", "c_mktsegment")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'red')")
def op_contains_text(t):
    return t.part.where(P.contains_text(F.col("p_name"), "RED")).select("p_partkey", "p_name")


@query("select p_partkey, p_brand from part where starts_with(lower(p_brand), 'brand#1')")
def op_prefix_filter(t):
    return t.part.where(P.starts_text(F.col("p_brand"), "BRAND#1")).select("p_partkey", "p_brand")


@query("select p_partkey, p_name from part where contains(lower(trim(p_name)), 'small ring box') or contains('small ring box', lower(trim(p_name)))")
def op_fuzzy_containment(t):
    return t.part.where(P.contains_either_way(F.col("p_name"), "Small ring box")).select("p_partkey", "p_name")


@query()
def op_fuzzy_ratio(t):
    return t.part.where(P.resembles(F.col("p_name"), "smal rign")).select("p_partkey", "p_name")


@query()
def op_fuzzy_score(t):
    scored = t.part.select("p_partkey", "p_name", F.round(fuzzy.score(["smal", "ring"], F.col("p_name"), F.col("p_brand")), 6).alias("score"))
    return records.page(scored.where("score > 0.5"), [F.desc("score"), F.col("p_partkey")], 50)


@query()
def op_closest_choice(t):
    return t.customer.select("c_custkey", fuzzy.closest(F.col("c_mktsegment"), ["MACHINE", "FURNITUR", "HOUSE"]).alias("closest"))


@query("select s_suppkey, s_acctbal from supplier where s_acctbal >= 1000 and s_acctbal <= 6000")
def op_range(t):
    return t.supplier.where(P.in_range(F.col("s_acctbal"), 1000, 6000)).select("s_suppkey", "s_acctbal")


@query("""select l_orderkey, l_linenumber, coalesce(case when l_discount > 0.05 then l_discount end, case when l_tax > 0.02 then l_tax end, l_quantity) as number
from lineitem""")
def op_coalesce_value(t):
    number = P.first_number(F.when(F.col("l_discount") > 0.05, F.col("l_discount")), F.when(F.col("l_tax") > 0.02, F.col("l_tax")), F.col("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", number.alias("number"))


@query("select l_orderkey, l_linenumber from lineitem where l_quantity between 10 and 20 and l_discount >= 0.03 and l_tax <= 0.05")
def op_dynamic_range(t):
    bounds = {"l_quantity": (10, 20), "l_discount": (0.03, None), "l_tax": (None, 0.05)}
    return t.lineitem.where(P.every(*[P.in_range(F.col(c), *b) for c, b in bounds.items()])).select("l_orderkey", "l_linenumber")


@query("select l_orderkey, string_agg(distinct l_returnflag, ',' order by l_returnflag) as flags from lineitem group by l_orderkey having bool_or(l_returnflag = 'R')")
def op_array_member(t):
    flags = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("flags"))
    return flags.where(P.has_member(F.col("flags"), "R")).select("l_orderkey", text_list(F.col("flags")).alias("flags"))


@query("select c_custkey, exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000) as has_large from customer")
def op_has_link(t):
    large = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("k")).distinct()
    return t.customer.join(large, F.col("c_custkey") == F.col("k"), "left").select("c_custkey", F.col("k").isNotNull().alias("has_large"))


@query("select l_orderkey, l_linenumber from lineitem where abs(l_discount - 0.04) < 1e-9")
def op_number_tolerance(t):
    return t.lineitem.where(P.has_number(F.array("l_discount"), 0.04)).select("l_orderkey", "l_linenumber")


@query("select page_id, url from pages where regexp_full_match(url, 'https?://[^/]+/(en|fr)/[0-9]+.*')")
def op_full_match(t):
    return t.pages.where(P.fullmatch(F.col("url"), r"https?://[^/]+/(en|fr)/[0-9]+.*")).select("page_id", "url")


@query("""select s_suppkey, s_name from supplier where s_name = 'Supplier#000000003' or
coalesce(nullif(regexp_extract('x-' || lower(right(s_name, 6)), '-([a-z0-9]{6})(\\.|$)', 1), ''), '') = '000007'""")
def op_serial_match(t):
    name = F.concat(F.lit("x-"), F.lower(F.right("s_name", F.lit(6))))
    return t.supplier.where((F.col("s_name") == "Supplier#000000003") | P.serial_matches(name, "q-000007")).select("s_suppkey", "s_name")


@query("select event_id, event_type from events where event_type in ('error', 'view') and user_id = 5")
def op_batch_or_serials(t):
    chosen = P.batch_or_serials(F.col("user_id"), F.col("event_type"), None, ["error", "view"])
    return t.events.where(chosen & P.batch_or_serials(F.col("user_id"), F.col("event_type"), 5, ["none"])).select("event_id", "event_type")


@query("""with u as (select 'local' as origin, p_partkey, p_name from part where p_size < 10 union all select 'packaged', p_partkey, p_name from part where p_size > 45)
select * from u order by origin, p_partkey offset 3 limit 25""")
def op_federated_union(t):
    both = records.federated(local=t.part.where("p_size < 10").select("p_partkey", "p_name"), packaged=t.part.where("p_size > 45").select("p_partkey", "p_name"))
    return records.page(both, [F.col("origin"), F.col("p_partkey")], 25, 3)


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def op_top_matches(t):
    return records.page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 10)


@query("select n_nationkey from nation except select s_nationkey from supplier")
def op_set_difference(t):
    return t.nation.select("n_nationkey").subtract(t.supplier.select(F.col("s_nationkey").alias("n_nationkey")))


@query("select c_nationkey as k from customer intersect select s_nationkey from supplier")
def op_set_intersection(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select(F.col("s_nationkey").alias("k")))


# Identity, dedup, change


@query("select o_custkey, min(o_orderkey) as o_orderkey, arg_min(o_totalprice, o_orderkey) as o_totalprice from orders group by o_custkey")
def op_first_wins(t):
    return records.first_wins(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_orderkey")])


@query("select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id")
def op_last_wins(t):
    rows = t.events.select("user_id", "event_id", "event_type", "ts")
    return records.last_wins(rows, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("select p_name, count(*) as n_rows, count(distinct (p_brand, p_type)) as n_variants from part group by p_name having count(distinct (p_brand, p_type)) > 1")
def op_name_conflict(t):
    return records.name_conflicts(t.part, "p_name", ["p_brand", "p_type"])


def _uid_sql(digest: str, first: int, key: str, table: str) -> str:
    char = "substr('0123456789abcdefghjkmnpqrstvwxyz', cast((cast('0x' || substr({d}, {f}, 5) as bigint) // {p}) % 32 as integer) + 1, 1)"
    groups = [" || ".join(char.format(d=digest, f=first + 5 * g, p=32**k) for k in (3, 2, 1, 0)) for g in range(4)]
    return f"select {key}, {" || '-' || ".join(groups)} as uid from {table}"


@query(_uid_sql("sha256('customer::' || c_name)", 13, "c_custkey", "customer"))
def op_stable_uid(t):
    return t.customer.select("c_custkey", identity.stable_uid(F.concat(F.lit("customer::"), "c_name")).alias("uid"))


@query(_uid_sql("sha1('customer::' || c_name)", 1, "c_custkey", "customer"))
def op_uid_sha1(t):
    return t.customer.select("c_custkey", identity.sha1_uid(F.concat(F.lit("customer::"), "c_name")).alias("uid"))


def _byte_uid_sql() -> str:
    d = "sha256(c_name || chr(31) || c_mktsegment)"
    chars = [f"substr('0123456789abcdefghjkmnpqrstvwxyz', cast(cast('0x' || substr({d}, {1 + 2 * i}, 2) as bigint) % 32 as integer) + 1, 1)" for i in range(16)]
    return f"select c_custkey, {" || '-' || ".join(' || '.join(chars[4 * g : 4 * g + 4]) for g in range(4))} as uid from customer"


@query(_byte_uid_sql())
def op_uid_bytes(t):
    return t.customer.select("c_custkey", identity.bytewise_uid("c_name", "c_mktsegment").alias("uid"))


@query("""with s as (select s_suppkey, translate(lower(substr(md5(s_name), 1, 12) || 'OIL1'), 'oil', '011') as u from supplier)
select s_suppkey, substr(u, 1, 4) || '-' || substr(u, 5, 4) || '-' || substr(u, 9, 4) || '-' || substr(u, 13, 4) as uid, substr(u, 1, 6) as short_id from s""")
def op_uid_normalise(t):
    uid = identity.normalised_uid(F.concat(F.substring(F.md5("s_name"), 1, 12), F.lit("OIL1")))
    return t.supplier.select("s_suppkey", uid.alias("uid"), identity.short_id_of_iri(F.concat(F.lit("https://example.org/cell/"), uid)).alias("short_id"))


@query("""select p_partkey, p_name, p_brand, row_number() over (partition by p_name, p_brand order by p_partkey) - 1 as ordinal,
count(*) over (partition by p_name) > 1 as shared from part""")
def op_disambiguation(t):
    from pyspark.sql import Window as W

    ordinal = F.row_number().over(W.partitionBy("p_name", "p_brand").orderBy("p_partkey")) - 1
    return t.part.select("p_partkey", "p_name", "p_brand", ordinal.cast("long").alias("ordinal"), (F.count(F.lit(1)).over(W.partitionBy("p_name")) > 1).alias("shared"))


@query("select p_name, count(*) as n, count(*) as n_uids from part group by p_name")
def op_disambiguated_uids(t):
    uids = records.disambiguated(t.part.select("p_partkey", "p_name", "p_brand"), identity.seed_of(F.lit("part"), F.col("p_name")), ["p_name", "p_brand", "p_partkey"])
    return uids.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("n_uids"))


@query("""with a as (select o_orderkey, o_orderstatus, case when o_orderpriority = '1-URGENT' then o_totalprice + 1 else o_totalprice end as p from orders where o_orderdate >= timestamp '1996-01-01'),
b as (select o_orderkey, o_orderstatus, o_totalprice as p from orders where o_orderdate < timestamp '2000-01-01')
select case when a.o_orderkey is null then 'kept' when b.o_orderkey is null then 'created' when a.p = b.p and a.o_orderstatus = b.o_orderstatus then 'exists' else 'updated' end as status, count(*) as n
from a full outer join b on a.o_orderkey = b.o_orderkey group by 1""")
def op_upsert_status(t):
    incoming = t.orders.where("o_orderdate >= timestamp_ntz'1996-01-01'").withColumn("o_totalprice", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    stored = t.orders.where("o_orderdate < timestamp_ntz'2000-01-01'")
    return records.upsert_status(incoming, stored, "o_orderkey", ["o_orderstatus", "o_totalprice"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, case when o_orderstatus <> 'P' then o_totalprice + 1 else o_totalprice end as o_totalprice from orders")
def op_upserted(t):
    changed = t.orders.where("o_orderstatus <> 'P'").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"))
    return records.upserted(changed, t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("select event_id, md5(props) as payload from events where not (event_type = 'click' and value < 20)")
def op_journal_skip(t):
    done = t.events.where("event_type = 'click' and value < 20").select("event_id", F.md5("props").alias("payload"))
    return records.not_done(t.events.select("event_id", F.md5("props").alias("payload")), done, ["event_id", "payload"])


@query("""with l as (select p_partkey, md5(p_name) as c from part where p_size > 5), r as (select p_partkey, md5(case when p_type = 'PROMO' then 'x' else p_name end) as c from part where p_size < 40)
select coalesce(l.p_partkey, r.p_partkey) as p_partkey, case when l.p_partkey is null then 'delete' when l.c = r.c then 'keep' else 'upload' end as action from l full outer join r on l.p_partkey = r.p_partkey""")
def op_sync_diff(t):
    local = t.part.where("p_size > 5").select("p_partkey", F.md5("p_name").alias("c"))
    remote = t.part.where("p_size < 40").select("p_partkey", F.md5(F.when(F.col("p_type") == "PROMO", "x").otherwise(F.col("p_name"))).alias("c"))
    return records.sync_plan(local, remote, "p_partkey", "c")


@query("select p_partkey, coalesce(case when p_size < 15 and p_brand <> 'Brand#2' then 'manual' end, p_type) as p_type from part")
def op_override(t):
    manual = t.part.where("p_size < 15").select("p_partkey", F.when(F.col("p_brand") != "Brand#2", "manual").otherwise("?").alias("p_type"))
    return records.overridden(t.part, manual, "p_partkey", "p_type")


@query("""with k as (select s_suppkey, unnest(list_distinct([s_name, right(s_name, 1), cast(s_nationkey as varchar)])) as key from supplier)
select key, count(distinct s_suppkey) as n_ids, case when count(distinct s_suppkey) = 1 then min(s_suppkey) end as id from k group by key""")
def op_ambiguous_key(t):
    return records.key_index(t.supplier, "s_suppkey", [F.col("s_name"), F.right("s_name", F.lit(1)), F.col("s_nationkey").cast("string")])


# References and joins


@query("""select o_orderkey as id, 'customer_id' as path, cast(o_custkey as varchar) as target, 'reference.missing' as code from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 2000)""")
def op_refs_missing(t):
    found = references.links(t.orders, "o_orderkey", {"customer_id": (F.col("o_custkey"), "customer")})
    return references.missing(found, t.customer.where("c_acctbal > 2000").select(F.col("c_custkey").cast("string").alias("target")))


@query("""select l_orderkey as id, 'part_id' as path, cast(l_partkey as varchar) as target, 'part' as expected, 'supplier' as actual, 'reference.type_mismatch' as code
from lineitem where l_partkey in (select s_suppkey from supplier join part on s_suppkey = p_partkey where p_size > 10)""")
def op_refs_type(t):
    store = t.part.select(F.col("p_partkey").alias("k"), "p_size").join(t.supplier.select(F.col("s_suppkey").alias("s")), F.col("k") == F.col("s"), "left")
    store = store.select(F.col("k").cast("string").alias("target"), F.when(F.col("s").isNotNull() & (F.col("p_size") > 10), "supplier").otherwise("part").alias("kind"))
    return references.mistyped(references.links(t.lineitem, "l_orderkey", {"part_id": (F.col("l_partkey"), "part")}), store)


@query("""with g as (select l_orderkey, l_partkey, row_number() over (partition by l_orderkey order by l_partkey) - 1 as i from (select distinct l_orderkey, l_partkey from lineitem))
select l_orderkey as id, 'parts[' || i || '].id' as path, cast(l_partkey as varchar) as target, 'reference.missing' as code from g where l_partkey in (select p_partkey from part where p_size <= 5)""")
def op_refs_list(t):
    lists = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("parts"))
    found = references.links(lists, "l_orderkey", {}, {"parts": (F.col("parts"), "part")})
    return references.missing(found, t.part.where("p_size > 5").select(F.col("p_partkey").cast("string").alias("target")))


@query("""with f as (select l_orderkey as id, unnest([{'path': 'part_id', 'target': l_partkey}, {'path': 'supplier_id', 'target': l_suppkey + 5}]) as l from lineitem)
select id, l.path as path, count(*) as n from f where (l.path = 'part_id' and l.target not in (select p_partkey from part where p_size > 3)) or (l.path = 'supplier_id' and l.target not in (select s_suppkey from supplier)) group by all""")
def op_refs_unpivoted(t):
    found = references.links(t.lineitem, "l_orderkey", {"part_id": (F.concat(F.lit("part/"), "l_partkey"), "part"), "supplier_id": (F.concat(F.lit("supplier/"), F.col("l_suppkey") + 5), "supplier")})
    store = t.part.where("p_size > 3").select(F.concat(F.lit("part/"), "p_partkey").alias("target")).unionByName(t.supplier.select(F.concat(F.lit("supplier/"), "s_suppkey").alias("target")))
    return references.missing(found, store).groupBy("id", "path").agg(F.count(F.lit(1)).alias("n"))


@query("""select event_id as id, case when event_type in ('click', 'view') then 'cell' else 'test' end as path, user_id as target from events
where case when event_type in ('click', 'view') then user_id not in (select c_custkey from customer) else user_id not in (select s_suppkey from supplier) end""")
def op_refs_routed(t):
    routed = t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_type").isin("click", "view"), "cell").otherwise("test").alias("path"), F.col("user_id").alias("target"))
    store = t.customer.select(F.lit("cell").alias("path"), F.col("c_custkey").alias("target")).unionByName(t.supplier.select(F.lit("test").alias("path"), F.col("s_suppkey").alias("target")))
    return routed.join(store, ["path", "target"], "left_anti").select("id", "path", "target")


@query("""with e as (select n_nationkey as pos, n_name as k, unnest([n_name, 'region ' || n_regionkey, 'N' || (n_nationkey % 10)]) as a, unnest([0, 1, 2]) as r from nation),
f as (select lower(trim(a)) as alias, arg_min(k, (pos, r)) as resolved from e group by 1),
q as (select s_suppkey, case when s_suppkey % 4 = 0 then 'unknown land' when s_suppkey % 2 = 0 then 'Region ' || (s_nationkey % 5) else ' n' || (s_nationkey % 10) end as land from supplier)
select s_suppkey, land, coalesce(resolved, land) as resolved from q left join f on lower(trim(land)) = alias""")
def op_alias_lookup(t):
    entries = t.nation.select(F.col("n_nationkey").alias("pos"), "n_name", F.concat(F.lit("region "), "n_regionkey").alias("a1"), F.concat(F.lit("N"), F.col("n_nationkey") % 10).alias("a2"))
    aliases = references.alias_table(entries, "n_name", ["n_name", "a1", "a2"])
    land = F.when(F.col("s_suppkey") % 4 == 0, "unknown land").when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Region "), F.col("s_nationkey") % 5)).otherwise(F.concat(F.lit(" n"), F.col("s_nationkey") % 10))
    return references.resolve(t.supplier.select("s_suppkey", land.alias("land")), "land", aliases)


@query("""select p_partkey, case p_size % 4 when 0 then 'mm' when 1 then 'cm' when 2 then null else 'furlong' end as unit,
case p_size % 4 when 0 then p_size * 1e-3 when 1 then p_size * 1e-2 when 2 then cast(p_size as double) end as metres from part""")
def op_unit_convert(t):
    unit = F.when(F.col("p_size") % 4 == 0, "mm").when(F.col("p_size") % 4 == 1, "cm").when(F.col("p_size") % 4 == 3, "furlong")
    return t.part.select("p_partkey", unit.alias("unit"), scalars.converted(F.col("p_size").cast("double"), unit, {"mm": 0.001, "cm": 0.01, "m": 1.0}).alias("metres"))


@query("""with v as (select p_partkey as id, unnest(['p_size', 'p_retailprice']) as property, unnest([cast(p_size as double), p_retailprice]) as value from part),
b(property, low, high) as (values ('p_size', 3.0, 40.0), ('p_retailprice', 905.0, 1000.0))
select id, property, value from v join b using (property) where value < low or value > high""")
def op_plausibility(t):
    values = t.part.select(F.col("p_partkey").alias("id"), F.explode(F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).cast("double").alias("value")) for c in ("p_size", "p_retailprice")])).alias("v")).select("id", "v.*")
    bounds = t.values([("p_size", 3.0, 40.0), ("p_retailprice", 905.0, 1000.0)], "property string, low double, high double")
    return references.outside_bounds(values, bounds, ["property"]).select("id", "property", "value")


@query("""select r_name, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name""")
def op_chain_join(t):
    small = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    chain = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(references.sized(small), F.col("c_nationkey") == F.col("n_nationkey"))
    return chain.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("""select c_custkey, coalesce(string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey), '') as orders, count(o_orderkey) as n
from customer left join orders on c_custkey = o_custkey group by c_custkey""")
def op_nested_graph(t):
    tree = graph.nested(t.customer, t.orders, "c_custkey", "o_custkey", ["o_orderkey", "o_totalprice"], "orders")
    return tree.select("c_custkey", text_list(F.transform("orders", lambda o: o["o_orderkey"])).alias("orders"), F.size("orders").cast("long").alias("n"))


@query("""with d as (select l_orderkey, count(*) as n, max(l_quantity) as q from lineitem group by l_orderkey)
select l_orderkey, case when l_orderkey % 5 = 0 and l_orderkey % 3 = 0 then 'n,q' when l_orderkey % 5 = 0 then 'n' else 'q' end as diverging from d where l_orderkey % 5 = 0 or l_orderkey % 3 = 0""")
def op_conformance(t):
    derived = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"))
    declared = derived.select("l_orderkey", F.when(F.col("l_orderkey") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("n"), F.when(F.col("l_orderkey") % 3 == 0, F.lit(None)).otherwise(F.col("q")).alias("q"))
    return rollups.conformance(declared, derived, "l_orderkey", ["n", "q"]).select("l_orderkey", text_list(F.col("diverging")).alias("diverging"))


@query("select page_id, doc_id from pages left join documents on doc_id = try_cast(nullif(regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1), '') as bigint)")
def op_derived_key_join(t):
    key = scalars.extracted(F.col("url"), r"/[a-z]{2}/([0-9]+)").try_cast("long")
    return t.pages.select("page_id", key.alias("k")).join(t.documents.select("doc_id"), F.col("k") == F.col("doc_id"), "left").select("page_id", "doc_id")


# Rollups


@query("""select 'customer' as kind, count(*) as n from customer union all select 'part', count(*) from part union all select 'supplier', count(*) from supplier
union all select 'total', (select count(*) from customer) + (select count(*) from part) + (select count(*) from supplier)""")
def op_kind_index(t):
    return rollups.kind_index({"customer": t.customer, "part": t.part, "supplier": t.supplier})


@query("""select o_custkey, coalesce(case when o_custkey % 2 = 0 then o_custkey end, count(*)) as n from orders group by o_custkey""")
def op_index_stats(t):
    lists = t.orders.groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("items"))
    return lists.select("o_custkey", rollups.counted(F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")), F.col("items")).alias("n"))


@query("""select o_orderpriority, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as claims, count(*) as n_claims from orders group by o_orderpriority""")
def op_collate(t):
    claims = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    out = rollups.collate(claims, "o_orderpriority", [F.col("o_orderkey")])
    return out.select("o_orderpriority", text_list(F.transform("claims", lambda c: c["o_orderkey"])).alias("claims"), "n_claims")


@query("select event_id, coalesce(case when event_id % 3 = 0 then 'claim' end, event_type) as citation from events")
def op_citation_override(t):
    claims = t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, "claim").alias("citation"), F.col("event_type").alias("source_citation"))
    return rollups.with_source_citation(claims, "citation", "source_citation")


_TIERS = "(values ('basic', ['AUTOMOBILE', 'BUILDING']), ('full', ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']))"


@query(f"""with have as (select c_nationkey, list(distinct c_mktsegment) as h from customer where c_acctbal > 9000 group by 1), tiers(tier, req) as {_TIERS}
select c_nationkey, tier, array_to_string(list_filter(req, lambda x: not list_contains(h, x)), ',') as missing, len(list_filter(req, lambda x: not list_contains(h, x))) = 0 as satisfied from have, tiers""")
def op_completeness(t):
    tiers = {"basic": ["AUTOMOBILE", "BUILDING"], "full": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]}
    out = rollups.completeness(t.customer.where("c_acctbal > 9000"), "c_nationkey", "c_mktsegment", tiers)
    return out.select("c_nationkey", "tier", text_list(F.col("missing")).alias("missing"), "satisfied")


@query("""with have as (select user_id, case when value < 10 then 'material_negative' when value < 30 then 'material_positive' when value < 50 then 'material' else 'separator' end as scope, event_type from events),
s as (select user_id, scope, list(distinct event_type) as h from have group by all), u as (select distinct user_id from have),
need(scope, req) as (values ('material_negative', ['click', 'view']), ('material_positive', ['click', 'view']), ('separator', ['error']))
select user_id, count_if(len(list_filter(req, lambda x: not list_contains(coalesce(a.h, b.h, []), x))) > 0) = 0 as satisfied,
coalesce(string_agg(case when len(list_filter(req, lambda x: not list_contains(coalesce(a.h, b.h, []), x))) > 0 then need.scope end, ',' order by need.scope), '') as gaps
from u cross join need left join s a using (user_id, scope) left join s b on b.user_id = u.user_id and b.scope = split_part(need.scope, '_', 1) group by user_id""")
def op_sided_completeness(t):
    scope = F.when(F.col("value") < 10, "material_negative").when(F.col("value") < 30, "material_positive").when(F.col("value") < 50, "material").otherwise("separator")
    out = rollups.sided_completeness(t.events.select("user_id", scope.alias("scope"), "event_type"), "user_id", "scope", "event_type", {"tier": {"material": ["click", "view"], "separator": ["error"]}})
    return out.select("user_id", "satisfied", text_list(F.array_sort(F.map_keys("missing"))).alias("gaps"))


@query("""with m as (select l_orderkey, l_returnflag, min(l_linenumber) as p from lineitem group by all), o as (select l_orderkey, string_agg(l_returnflag, ',' order by p, l_returnflag) as modes from m group by 1),
r as (select l_orderkey, string_agg(distinct cast(cast(round(l_discount * 100) as integer) as varchar), ',' order by cast(cast(round(l_discount * 100) as integer) as varchar)) as discounts, min(l_quantity) as low, max(l_quantity) as high, bool_or(l_linestatus = 'O') as has_open from lineitem group by 1)
select * from o join r using (l_orderkey)""")
def op_facet_rollup(t):
    cents = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    out = rollups.facet_rollup(t.lineitem, "l_orderkey", F.col("l_linenumber"), F.col("l_returnflag"), F.col("l_quantity"), {"has_open": F.col("l_linestatus") == "O"}, cents)
    return out.select("l_orderkey", text_list(F.col("modes")).alias("modes"), text_list(F.col("distinct_values")).alias("discounts"), "low", "high", "has_open")


@query("select user_id, cast(count_if(event_type = 'click') as bigint) as click, cast(count_if(event_type = 'error') as bigint) as error, cast(count_if(event_type = 'view') as bigint) as view, count(*) as total from events group by user_id")
def op_status_pivot(t):
    return rollups.status_pivot(t.events, "user_id", "event_type", ["click", "error", "view"])


@query("select coalesce(case when o_orderstatus <> 'P' then o_orderstatus end, 'unknown') as status, count(*) as n from orders group by 1")
def op_status_groups(t):
    status = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.lit("unknown"))
    return t.orders.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("select l_orderkey, round(sum(case when l_returnflag <> 'N' then l_quantity end), 4) as known from lineitem group by l_orderkey")
def op_null_aware_sum(t):
    return t.lineitem.groupBy("l_orderkey").agg(rollups.null_aware_sum(F.when(F.col("l_returnflag") != "N", F.col("l_quantity"))).alias("known"))


@query("""select c_nationkey, c_mktsegment, round(count(*) / sum(count(*)) over (partition by c_nationkey), 4) as share from customer group by c_nationkey, c_mktsegment""")
def op_share(t):
    from pyspark.sql import Window as W

    counts = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("c_nationkey", "c_mktsegment", F.round(F.col("n") / F.sum("n").over(W.partitionBy("c_nationkey")), 4).alias("share"))


@query("select o_custkey, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as ids, count(*) as n from orders group by o_custkey")
def op_fan_in(t):
    out = rollups.fan_in(t.orders, "o_custkey", "o_orderkey")
    return out.select("o_custkey", text_list(F.col("ids")).alias("ids"), "n")


@query("select event_type, epoch_us(min(ts)) // 1000000 as covers_from, epoch_us(max(ts)) // 1000000 as covers_to from events group by event_type")
def op_coverage(t):
    seconds = scalars.unix_of_timestamp(F.col("ts"))
    return rollups.coverage(t.events, "event_type", seconds, seconds)


@query("select p_name, string_agg(distinct p_brand, ',' order by p_brand) as keys from part group by p_name having count(distinct p_brand) > 1")
def op_collision(t):
    return rollups.collisions(t.part, "p_name", "p_brand").select("p_name", text_list(F.col("keys")).alias("keys"))


@query("select doc_id, sha256(text) as sha256, md5(text) as md5 from documents")
def op_checksums(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("select source, cast(sum(strlen(text)) as bigint) as bytes, count(*) as n from documents group by source")
def op_size_totals(t):
    return t.documents.groupBy("source").agg(F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.count(F.lit(1)).alias("n"))


# Series


@query("select user_id, arg_min(value, (ts, event_id)) as first_value, arg_max(value, (ts, event_id)) as last_value from events group by user_id")
def op_first_last(t):
    return series.first_last(t.events, "user_id", "value", ["ts", "event_id"])


@query("""with n as (select *, row_number() over (partition by user_id order by ts, event_id) - 1 as i, case when count(*) over (partition by user_id) > 5 then count(*) over (partition by user_id) // 5 + 1 else 1 end as k from events)
select user_id, event_id, value from n where i % k = 0""")
def op_downsample(t):
    return series.downsample(t.events, "user_id", ["ts", "event_id"], 5).select("user_id", "event_id", "value")


@query("select user_id, epoch_us(min(ts)) // 1000000 as first_ts, epoch_us(max(ts)) // 1000000 as last_ts from events group by user_id")
def op_period(t):
    out = series.period(t.events, "user_id", "ts")
    return out.select("user_id", scalars.unix_of_timestamp(F.col("first_ts")).alias("first_ts"), scalars.unix_of_timestamp(F.col("last_ts")).alias("last_ts"))


@query("select * from (values (0, 'user_id', null), (1, 'measured_value', 'V'), (2, 'kind', null)) as v(pos, name, unit)")
def op_profile(t):
    shaped = t.events.select("user_id", F.col("value").alias("Measured value / V"), F.col("value").alias("measured_value / mV"), F.col("event_type"))
    return series.profile(shaped, {"event_type": ("kind", None)})


# Scalars


@query("""select event_id, epoch_us(ts) // 1000000 as seconds, strftime(to_timestamp(epoch_us(ts) // 1000000) at time zone 'UTC', '%Y-%m-%dT%H:%M:%SZ') as iso from events""")
def op_unix_time(t):
    seconds = scalars.unix_time(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return t.events.select("event_id", seconds.alias("seconds"), scalars.iso_time(seconds).alias("iso"))


@query("""select * from (values (0, 1704067200::bigint), (1, 1704067200), (2, 1704110400), (3, 1704106800), (4, null), (5, 170406720), (6, null), (7, null), (8, 1704110399)) v(id, seconds)""")
def op_time_forms(t):
    forms = ["2024-01-01", "2024-01-01T00:00:00Z", "2024-01-01 12:00", "2024-01-01T12:00:00+01:00", "20240101", "170406720", "soon", "", "2024-01-01T11:59:59.9"]
    return t.values(list(enumerate(forms)), "id int, text string").select("id", scalars.unix_time(F.col("text")).alias("seconds"))


@query("""select page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug,
case when contains(lower(url), 'example.com') then 'commercial' when contains(lower(url), 'example.org') then 'organisation' else 'other' end as kind from pages""")
def op_filename_parse(t):
    kind = scalars.first_keyword(F.col("url"), {"example.com": "commercial", "example.org": "organisation"})
    return t.pages.select("page_id", scalars.slug(F.col("url")).alias("slug"), kind.alias("kind"))


@query("select s_suppkey, upper(regexp_extract(s_name, '^([A-Za-z]+)', 1)) || '__' || lower(right(s_name, 9)) as batch from supplier")
def op_batch_key(t):
    stem = F.concat(F.lower(F.regexp_extract("s_name", "^([A-Za-z]+)", 1)), F.lit("___"), F.upper(F.right("s_name", F.lit(9))), F.lit("_127.0.0.1-CH-"), "s_suppkey")
    return t.supplier.select("s_suppkey", scalars.batch_key(stem).alias("batch"))


@query("select p_partkey, p_name as label, p_brand as unit from part")
def op_label_split(t):
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" / "), "p_brand")).otherwise(F.concat("p_name", F.lit(" ["), "p_brand", F.lit("]")))
    return t.part.select("p_partkey", scalars.label_of(text).alias("label"), scalars.unit_of(text).alias("unit"))


@query("""select p_partkey, case when p_size % 5 = 0 then null when p_size % 5 = 1 then null when p_size % 5 = 2 then null else cast(p_size as double) end as number from part""")
def op_sentinel_clean(t):
    size = F.col("p_size")
    text = F.when(size % 5 == 0, " NA ").when(size % 5 == 1, "nan").when(size % 5 == 2, "12x").otherwise(F.concat(F.lit(" "), size.cast("string")))
    return t.part.select("p_partkey", scalars.finite_number(text).alias("number"))


_STEPS = ["Charge at C/{n} until 4.1 V", "Hold at 4.2 V until C/50", "Discharge at 200 mA until 2.5 V or for {n} hours", "Rest for 30 minutes", "discharge at 2 W", "Explode at 4 V", "Rest for 3 parsecs", "Charge at 4.2 V until C/20", "Discharge at 3 V for 1 hour"]


def _step_texts(t):
    """A step for each event: one of the forms, with a number of the event's."""
    n = (F.col("event_id") % 7 + 1).cast("string")
    form = F.element_at(F.array(*map(F.lit, _STEPS)), (F.col("event_id") % len(_STEPS) + 1).cast("int"))
    return t.events.select("event_id", F.replace(form, F.lit("{n}"), n).alias("text"))


@query("""with e as (select event_id, event_id % 9 as k, event_id % 7 + 1 as n from events)
select event_id, case when k in (0, 2) then 'cc' when k in (1, 7, 8) then 'cv' when k in (3, 6) then 'rest' when k = 4 then 'cp' end as mode,
case when k in (0, 7) then 'charge' when k = 1 then 'hold' when k in (2, 4, 8) then 'discharge' when k in (3, 6) then 'rest' end as direction,
case when k = 0 then 'c_rate' when k in (1, 7, 8) then 'voltage' when k = 2 then 'current' when k = 4 then 'power' end as kind,
case when k = 0 then round(1.0 / n, 6) when k in (1, 7) then 4.2e0 when k = 2 then 0.2e0 when k = 4 then 2e0 when k = 8 then 3e0 end as amount,
case when k = 2 then n * 3600e0 when k = 3 then 1800e0 when k = 8 then 3600e0 end as duration_s,
case when k = 0 then 'voltage 4.1 above' when k = 1 then 'c_rate 0.02 below' when k = 2 then 'voltage 2.5 below' when k = 7 then 'c_rate 0.05 below' else '' end as ends,
case when k = 5 then 'no operation' when k = 6 then 'bad duration' end as problem from e""")
def op_step_parse(t):
    s = F.col("s")
    ends = F.array_join(F.transform(s["termination"], lambda e: F.concat_ws(" ", e["quantity"], S.number_text(e["value"]), e["direction"])), ";")
    rows = _step_texts(t).withColumn("s", S.step(F.col("text")))
    return rows.select("event_id", s["mode"].alias("mode"), s["direction"].alias("direction"), s["setpoint"]["kind"].alias("kind"), F.round(s["setpoint"]["value"], 6).alias("amount"), s["duration_s"].alias("duration_s"), F.coalesce(ends, F.lit("")).alias("ends"), s["problem"].alias("problem"))


@query("""select event_id, case event_id % 9 when 1 then 'Hold at 4.2 V until 0.02C' when 2 then 'Discharge at 0.2 A for ' || (event_id % 7 + 1) * 3600 || ' seconds or until 2.5 V' when 3 then 'Rest for 1800 seconds'
when 4 then 'Discharge at 2 W' when 7 then 'Charge at 4.2 V until 0.05C' when 8 then 'Discharge at 3 V for 3600 seconds' end as text from events where event_id % 9 not in (0, 5, 6)""")
def op_step_render(t):
    return _step_texts(t).where("event_id % 9 not in (0, 5, 6)").select("event_id", S.rendered(S.step(F.col("text"))).alias("text"))


@query("select 1 as id, 'cc,cv,rest' as modes, 'charge,discharge' as directions, 'current,voltage' as control_modes, true as has_cv_hold, true as has_rest, false as has_eis, '0.02,0.5,1.0' as c_rates, '2.5,4.2' as voltage_window")
def op_method_facets(t):
    steps = ["Charge at 1C until 4.2 V", "Hold at 4.2 V until C/50", "Rest for 1 hour", "Discharge at 0.5C until 2.5 V"]
    rows = t.values([(1, steps)], "id int, texts array<string>").withColumn("f", S.facets(F.transform("texts", lambda x: S.step(x))))
    return rows.select("id", *[text_list(F.col(f"f.{c}")).alias(c) for c in ("modes", "directions", "control_modes")], "f.has_cv_hold", "f.has_rest", "f.has_eis", text_list(F.col("f.c_rates")).alias("c_rates"), text_list(F.col("f.voltage_window")).alias("voltage_window"))


@query("select o_orderkey, cast(printf('%.5e', o_totalprice) as double) as price6 from orders")
def op_sig6(t):
    return t.orders.select("o_orderkey", scalars.significant(F.col("o_totalprice")).alias("price6"))


@query("select l_orderkey, l_linenumber, round(l_discount * 100 / 100, 6) as discount from lineitem")
def op_fraction(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", scalars.fraction(F.col("l_discount") * 100, F.lit("%")).alias("discount"))


@query("""select p_partkey, cast(printf('%.5e', case when p_size % 2 = 0 then pi() * p_size * p_size / 4 * 10 else p_size * 20.0 end) as double) as volume from part""")
def op_geometry(t):
    size = F.col("p_size").cast("double")
    form = F.when(F.col("p_size") % 2 == 0, "Cylindrical").otherwise("pouch")
    g = scalars.volume_and_area(form, size, F.when(F.col("p_size") % 2 == 0, F.lit(10.0)).otherwise(F.lit(10.0)), F.lit(2.0), size)
    return t.part.select("p_partkey", g["volume"].alias("volume"))


@query("""with c as (select c_custkey, c_custkey % 4 as k, c_nationkey % 9 + 1 as n from customer)
select c_custkey, case when k < 2 then n / 2.0 when k = 3 then 1.0 end as concentration, case k when 0 then 'LiPF6' when 1 then 'LiTFSI' when 3 then 'LiFSI' end as salt,
case k when 0 then 'EC 0.3,EMC 0.7' when 1 then 'EC ,DMC ' when 3 then 'EC 1.0' end as solvents from c""")
def op_electrolyte(t):
    strength = ((F.col("c_nationkey") % 9 + 1) / 2).cast("string")
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(strength, F.lit("M LiPF6 EC:EMC=3:7wt%"))).when(k == 1, F.concat(strength, F.lit(" M LiTFSI in EC:DMC"))).when(k == 2, "secret sauce").otherwise("1M LiFSI EC:EC=1:1")
    e = scalars.electrolyte(text)
    solvents = F.array_join(F.transform(e["solvents"], lambda s: F.concat(s["name"], F.lit(" "), F.coalesce(s["fraction"].cast("string"), F.lit("")))), ",")
    return t.customer.select("c_custkey", e["concentration"].alias("concentration"), e["salt"].alias("salt"), solvents.alias("solvents"))


@query("""select * from (values (0, 'https://doi.org/10.1/a', null, null), (1, 'https://doi.org/10.1234/x', '0000-0002-1825-0097', 'https://ror.org/05abc'), (2, 'plain text', null, 'https://ror.org/x')) v(id, citation, orcid, ror)""")
def op_normalisers(t):
    rows = t.values([(0, None, "10.1/a", "bad", None), (1, "https://dx.doi.org/10.1234/x", None, "https://orcid.org/0000-0002-1825-0097", "05abc"), (2, "plain text", "10.1/b", None, "https://ror.org/x")], "id int, c string, d string, o string, r string")
    return rows.select("id", scalars.citation_url(F.col("c"), F.col("d")).alias("citation"), scalars.orcid(F.col("o")).alias("orcid"), scalars.ror(F.col("r")).alias("ror"))


@query("select page_id, case when starts_with(url, 'https://') then 's:' || substr(url, 9) when starts_with(url, 'http://') then 'h:' || substr(url, 8) else url end as short, true as same from pages")
def op_iri_compaction(t):
    prefixes = {"s": "https://", "h": "http://"}
    short = scalars.compacted_iri(F.col("url"), prefixes)
    return t.pages.select("page_id", short.alias("short"), (scalars.expanded_iri(short, prefixes) == F.col("url")).alias("same"))


# Validation


_RULES = """select l_orderkey as id, r.code as code, r.severity as severity from lineitem, lateral (select unnest([
case when l_discount > 0.09 then {'code': 'value_out_of_plausible_range', 'severity': 'warning'} end, case when l_quantity < l_linenumber then {'code': 'range_invalid', 'severity': 'error'} end,
case when l_tax = 0 then {'code': 'tax_missing', 'severity': 'warning'} end]) as r) where r is not null"""


def _line_rules():
    return [
        rules.Rule("value_out_of_plausible_range", "warning", "l_discount", F.col("l_discount") > 0.09, "discount out of range"),
        rules.Rule("range_invalid", "error", "l_quantity", rules.range_invalid(F.col("l_linenumber"), F.lit(None).cast("double"), F.col("l_quantity")), "quantity below line number"),
        rules.Rule("tax_missing", "warning", "l_tax", F.col("l_tax") == 0, "no tax"),
        rules.Rule("value_not_finite", "error", "l_extendedprice", rules.not_finite(F.col("l_extendedprice")), "not a number"),
        rules.Rule("timestamp_implausible", "error", "l_shipdate", rules.implausible_time(scalars.unix_of_timestamp(F.col("l_shipdate")) + 10**9), "time out of range"),
    ]


@query(f"select id, code, severity, count(*) as n from ({_RULES}) group by all")
def op_rule_issues(t):
    return rules.issues(t.lineitem, "l_orderkey", _line_rules()).groupBy("id", "code", "severity").agg(F.count(F.lit(1)).alias("n"))


@query(f"select cast(count_if(severity = 'error') as bigint) as n_errors, cast(count_if(severity = 'warning') as bigint) as n_warnings, count_if(severity = 'error') = 0 as ok from ({_RULES})")
def op_report(t):
    return rules.severities(rules.issues(t.lineitem, "l_orderkey", _line_rules()))


@query(f"select id, cast(count_if(severity = 'error') as bigint) as n_errors, cast(count_if(severity = 'warning') as bigint) as n_warnings, count_if(severity = 'error') = 0 as ok from ({_RULES}) group by id")
def op_report_by_record(t):
    return rules.severities(rules.issues(t.lineitem, "l_orderkey", _line_rules()), "id")


@query(f"select distinct 'warning' as severity, code from ({_RULES})")
def op_policy(t):
    return rules.under_policy(rules.issues(t.lineitem, "l_orderkey", _line_rules()), "semantic", "ingest").select("severity", "code").distinct()


@query("select o_custkey as id, 'duplicate_id' as code, count(*) as n from orders group by o_custkey having count(*) > 1")
def op_duplicate_ids(t):
    return rules.duplicated(t.orders, "o_custkey")


@query("select l_partkey as id, 'low > high' as message, 'range_invalid' as code from lineitem group by l_partkey having min(l_quantity) > max(l_discount) * 200")
def op_paired_range(t):
    sums = t.lineitem.groupBy(F.col("l_partkey").alias("id")).agg(F.min("l_quantity").alias("a"), (F.max("l_discount") * 200).alias("b"))
    values = sums.select("id", F.explode(F.array(F.struct(F.lit("low").alias("property"), F.col("a").alias("value")), F.struct(F.lit("high").alias("property"), F.col("b").alias("value")))).alias("v"), F.lit("u").alias("unit")).select("id", "v.*", "unit")
    return rules.paired(values, [("low", "high")])


@query("select c_custkey as id, c_mktsegment as value, 'controlled_value_unmapped' as code from customer where c_mktsegment in ('MACHINERY', 'BUILDING')")
def op_unmapped_values(t):
    return rules.unmapped(t.customer, "c_custkey", "c_mktsegment", ["automobile", "furniture", "household"])


@query("select p_partkey as id, p_type as property, p_brand as unit, 'unit_mismatch' as code from part where p_type = 'ECONOMY' and p_brand not in ('Brand#1', 'Brand#2')")
def op_unit_mismatch(t):
    return rules.unit_mismatches(t.part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("property"), F.col("p_brand").alias("unit")), {"ECONOMY": ["Brand#1", "Brand#2"]})


@query("""select p_partkey, case p_size % 5 when 1 then 'one value form' when 2 then 'curve lengths' when 3 then 'curve not finite' when 4 then 'unknown class' end as problem from part""")
def op_claim_checks(t):
    k, price = F.col("p_size") % 5, F.col("p_retailprice")
    xs = F.when(k == 1, F.array(price)).when(k == 2, F.array(price, price)).when(k == 3, F.array(price))
    ys = F.when(k.isin(1, 2), F.array(price)).when(k == 3, F.array(F.lit(float("inf"))))
    return t.part.select("p_partkey", rules.claim_problem(F.when(k < 2, price), xs, ys, F.when(k == 4, "x+1"), F.when(k == 4, "guess").otherwise("measured"), ["measured", "fitted"]).alias("problem"))


@query("select doc_id, sha256(text) as checksum, true as ok, false as short_ok from documents")
def op_checksum_shape(t):
    digest = F.sha2("text", 256)
    return t.documents.select("doc_id", digest.alias("checksum"), scalars.checksum_ok(F.lit("sha-256"), digest).alias("ok"), scalars.checksum_ok(F.lit("md5"), digest).alias("short_ok"))


@query("""select c_custkey as id, 'schema.enum' as code, 'c_mktsegment' as path from customer where c_mktsegment not in ('AUTOMOBILE', 'BUILDING')
union all select c_custkey, 'schema.maximum', 'c_acctbal' from customer where c_acctbal > 9500 union all select c_custkey, 'schema.pattern', 'c_name' from customer where not regexp_matches(c_name, '[0-4]$')
union all select c_custkey, 'schema.required', 'email' from customer""")
def op_schema_rules(t):
    wanted = {
        "required": ["c_name", "email"],
        "properties": {"c_mktsegment": {"enum": ["AUTOMOBILE", "BUILDING"]}, "c_acctbal": {"type": "number", "minimum": -1000, "maximum": 9500}, "c_name": {"pattern": "[0-4]$", "maxLength": 40}, "c_custkey": {"type": "integer"}},
    }
    columns = {c: F.col(c) for c in t.customer.columns}
    return rules.issues(t.customer, "c_custkey", schema.rules_of(wanted, columns)).select("id", "code", "path")


@query("""with p as (select p_partkey, p_type, case when p_size % 5 = 0 then 'CR' || p_size when p_size % 2 = 0 then 'R' || p_size else 'P' || p_size || '/50' end as code,
case p_type when 'SMALL' then 'coin' when 'LARGE' then 'cylindrical' when 'PROMO' then 'pouch' when 'ECONOMY' then 'prismatic' else 'other' end as form from part)
select p_partkey as id, case when left(code, 1) not in ('R', 'P') then 'size_code_invalid' else 'size_code_prefix_mismatch' end as code from p
where left(code, 1) not in ('R', 'P') or (form in ('coin', 'cylindrical') and left(code, 1) <> 'R') or (form in ('pouch', 'prismatic') and left(code, 1) <> 'P')""")
def op_size_codes(t):
    size = F.col("p_size").cast("string")
    code = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("CR"), size)).when(F.col("p_size") % 2 == 0, F.concat(F.lit("R"), size)).otherwise(F.concat(F.lit("P"), size, F.lit("/50")))
    form = scalars.mapped(F.col("p_type"), {"SMALL": "coin", "LARGE": "cylindrical", "PROMO": "Pouch", "ECONOMY": "prismatic"}, F.lit("other"))
    return rules.issues(t.part, "p_partkey", schema.size_code_rules(code, form)).select("id", "code")


@query("""select l_orderkey as id, l_linenumber, 'temporal_order_invalid' as code from lineitem join orders on l_orderkey = o_orderkey where l_shipdate < o_orderdate""")
def op_time_order(t):
    both = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("key", F.struct("l_orderkey", "l_linenumber"))
    found = rules.issues(both, "key", [schema.time_order_rule("l_shipdate", F.col("o_orderdate"), F.col("l_shipdate"))])
    return found.select(F.col("id.l_orderkey").alias("id"), F.col("id.l_linenumber").alias("l_linenumber"), "code")


@query("""with p as (select p_partkey, p_size % 3 <> 0 as by_polarity, p_size % 3 <> 1 as by_role, p_type in ('SMALL', 'LARGE') or (p_type = 'PROMO' and p_size > 25) as roles_wanted from part)
select p_partkey as id, case when by_polarity and by_role then 'electrode_holders_mixed' when by_polarity then 'electrode_role_expected' else 'electrode_polarity_expected' end as code, 'warning' as severity
from p where (by_polarity and by_role) or (by_polarity and roles_wanted) or (by_role and not roles_wanted)""")
def op_electrode_roles(t):
    configuration = scalars.mapped(F.col("p_type"), {"SMALL": "Half_Cell", "LARGE": "three-electrode", "ECONOMY": "full_cell"})
    made = schema.electrode_rules(configuration, F.col("p_size") % 3 != 0, F.col("p_size") % 3 != 1, (F.col("p_size") > 25) & (F.col("p_type") == "PROMO"))
    return rules.issues(t.part, "p_partkey", made).select("id", "code", "severity")


@query("""select p_partkey as id, case when p_size % 3 = 0 then 'material_kind_missing' else 'material_kind_unknown' end as code, case when p_size % 3 = 0 then 'warning' else 'error' end as severity
from part where p_size % 3 = 0 or p_type not in ('SMALL', 'PROMO')""")
def op_material_kinds(t):
    kind = F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.concat(F.col("p_type"), F.lit(" ")))
    return rules.issues(t.part, "p_partkey", schema.kind_rules(kind, ["small", "Promo"], "material")).select("id", "code", "severity")


@query("""select o_orderkey as id, 'dataset_missing_cell_link' as code from orders where o_orderstatus <> 'P' and o_orderkey not in (select l_orderkey from lineitem where l_quantity > 30)""")
def op_cell_links(t):
    cells = t.lineitem.where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_partkey").alias("cells"))
    both = t.orders.join(cells, F.col("o_orderkey") == F.col("k"), "left")
    return rules.issues(both, "o_orderkey", [schema.cell_link_rule(F.col("cells"), F.col("o_orderstatus") == "P")]).select("id", "code")


@query("select s_suppkey as id, 'short_id_mismatch' as code from supplier where s_suppkey % 2 = 1 union all select s_suppkey, 'identifier_uid_invalid' from supplier where s_suppkey % 5 = 0")
def op_identifiers(t):
    uid = identity.normalised_uid(F.substring(F.md5("s_name"), 1, 16))
    identifier = F.concat(F.lit("https://example.org/cell/"), uid, F.when(F.col("s_suppkey") % 5 == 0, "xyz").otherwise(""))
    short = F.when(F.col("s_suppkey") % 2 == 1, "zzzzzz").otherwise(F.upper(F.substring(F.md5("s_name"), 1, 6)))
    return rules.issues(t.supplier, "s_suppkey", schema.identifier_rules(identifier, short)).select("id", "code")


# Graphs and documents


@query("""select p_partkey, case p_size % 4 when 0 then 'r6 lr6 fr6 aa doublea' when 1 then '18650' when 2 then 'r03 lr03 fr03 aaa triplea' else 'x' || p_size end as codes from part""")
def op_size_aliases(t):
    k = F.col("p_size") % 4
    code = F.when(k == 0, "AA").when(k == 1, "18650").when(k == 2, "Triple-A").otherwise(F.concat(F.lit("X-"), "p_size"))
    return t.part.select("p_partkey", exports.size_aliases(code).alias("codes"))


@query("""select s_suppkey, coalesce(case when s_acctbal > 5000 then 'own' end, 'cc-by-4.0') as license, 'lab' as contributor from supplier""")
def op_stamped(t):
    rows = t.supplier.select("s_suppkey", F.when(F.col("s_acctbal") > 5000, "own").alias("license"))
    return exports.stamped(rows, {"license": "cc-by-4.0", "contributor": "lab"})


@query("""select 'page/' || page_id as id, '{"@id":"page/' || page_id || '","@type":"dcat:Dataset","dct:title":"p","dct:license":"mit","dcat:distribution":[{"@type":"dcat:Distribution","dcat:downloadURL":"' || url || '","dcat:mediaType":"text/html"}]}' as document from pages""")
def op_dcat(t):
    return exports.dcat(t.pages, F.concat(F.lit("page/"), "page_id"), F.lit("p"), F.lit("mit"), F.col("url"), F.lit("text/html"))


@query("""select n_regionkey as id, '{"@context":"https://w3id.org/ro/crate/1.1/context","@graph":[' || string_agg('{"@id":"' || n_name || '","@type":"File","contentSize":' || n_nationkey || ',"sha256":"' || sha256(n_name) || '"}', ',' order by n_name) || ']}' as document from nation group by n_regionkey""")
def op_ro_crate(t):
    return exports.ro_crate(t.nation, "n_regionkey", F.col("n_name"), F.col("n_nationkey"), F.sha2("n_name", 256))


@query("""select s_suppkey as source_local_id, 'supplier' as resource_type, '{"name":"' || s_name || '"}' as payload, sha256('{"name":"' || s_name || '"}') as payload_hash, 'v1' as workflow from supplier""")
def op_envelope(t):
    return exports.envelope(t.supplier, F.col("s_suppkey"), "supplier", F.struct(F.col("s_name").alias("name")), "v1")


@query("""select p_partkey, p_name from part where contains(lower(p_name), 'gear') and p_type = 'PROMO'""")
def op_search(t):
    return exports.search(t.part, "p_name", "p_type", "GEAR", "PROMO").select("p_partkey", "p_name")


@query("""select 'nation/' || n_nationkey as s, t.p as p, t.o as o, t.i as is_iri from nation, lateral (select unnest([{'p': 'rdf:type', 'o': 'Nation', 'i': true}, {'p': 'name', 'o': n_name, 'i': false}, {'p': 'inRegion', 'o': 'region/' || n_regionkey, 'i': true}]) as t)""")
def op_triples(t):
    return graph.triples(t.nation, F.concat(F.lit("nation/"), "n_nationkey"), "Nation", {"name": F.col("n_name")}, {"inRegion": F.concat(F.lit("region/"), "n_regionkey")})


@query("""select 'r/' || r_regionkey as s, p, case when p = 'name' and r_regionkey < 2 then 'renamed' when p = 'name' then r_name else 'Region' end as o, p <> 'name' as is_iri from region, (values ('rdf:type'), ('name')) v(p)""")
def op_graph_merge(t):
    subject = F.concat(F.lit("r/"), "r_regionkey")
    old = graph.triples(t.region, subject, "Region", {"name": F.col("r_name")})
    new = graph.triples(t.region.where("r_regionkey < 2"), subject, "Region", {"name": F.lit("renamed")})
    return graph.merged(old, new)


@query("select '<https://example.org/n/' || n_nationkey || '> <https://example.org/name> \"' || n_name || '\" .' as value from nation")
def op_n_triples(t):
    return graph.n_triples(t.nation.select(F.concat(F.lit("https://example.org/n/"), "n_nationkey").alias("s"), F.lit("https://example.org/name").alias("p"), F.col("n_name").alias("o"), F.lit(False).alias("is_iri")))


@query("""select 'nation/' || n_nationkey as id, '{"@context":"https://example.org/c","@id":"nation/' || n_nationkey || '","@type":["Nation"],"name":"' || n_name || '"}' as document from nation""")
def op_json_ld(t):
    return graph.json_ld(t.nation, F.concat(F.lit("nation/"), "n_nationkey"), F.array(F.lit("Nation")), {"name": F.col("n_name")}, "https://example.org/c")


@query("select event_id as id, 'k' as json_key, json_extract_string(props, '$.k') as json_value from events")
def op_json_walk(t):
    return graph.json_keys(t.events, "event_id", "props")


@query("select p_partkey as id, 'material_spec_id' as name, p_brand as target from part union all select p_partkey, 'base_material_id', p_type from part")
def op_deep_references(t):
    document = F.to_json(F.struct(F.struct(F.col("p_brand").alias("material_spec_id"), F.struct(F.col("p_type").alias("base_material_id")).alias("deep")).alias("a"), F.col("p_name").alias("other")))
    return graph.deep_references(t.part.select("p_partkey", document.alias("d")), "p_partkey", "d", ["material_spec_id", "base_material_id"])


@query("select event_id as id, 'a.q' as path, cast(json_extract(props, '$.k') as double) as value, 'V' as unit from events")
def op_quantities(t):
    document = F.concat(F.lit('{"a": {"q": {"unit": "V", "value": '), F.get_json_object("props", "$.k"), F.lit('}, "flag": {"value": true}}}'))
    return importers.quantities(t.events.select("event_id", document.alias("d")), "event_id", "d")


@query("""select p_partkey, case p_type when 'ECONOMY' then 'Cheap,Thing' when 'SMALL' then 'Small,Thing' else 'Thing' end as types from part""")
def op_type_stack(t):
    return t.part.select("p_partkey", text_list(graph.stacked_types((F.col("p_type"), {"economy": "Cheap", "small": "Small"}), (F.lit("any"), {"any": "Thing"}))).alias("types"))


# Importers


@query("""select 'material-spec' as kind, count(*) as n from (select distinct 'cathode' as role, p_type as name from part union select 'anode', p_brand from part where p_size % 3 <> 0)
union all select 'cell-spec', count(*) from part union all select 'cell', count(*) from part union all select 'test', cast(count_if(p_size % 2 = 0) as bigint) from part""")
def op_import_rows(t):
    made = importers.from_rows(
        t.part, F.col("p_partkey"), F.col("p_brand"), F.col("p_name"), {"cathode": F.col("p_type"), "anode": F.when(F.col("p_size") % 3 == 0, "NA").otherwise(F.col("p_brand"))},
        F.col("p_size"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("nr"),
    )
    return rollups.kind_index({k: v.select("id").distinct() for k, v in made.items()}).where("kind <> 'total'")


@query("select p_partkey as source, 'cycling' as flag, 'cycling' as kind from part where p_size > 20 and p_retailprice > 905 union all select p_partkey, 'impedance', 'eis' from part where p_size <= 30 and p_retailprice > 905")
def op_import_flags(t):
    flags = F.create_map(F.lit("cycling"), F.col("p_size") > 20, F.lit("impedance"), F.col("p_size") <= 30)
    return importers.from_flags(t.part, F.col("p_partkey"), flags, {"cycling": "cycling", "impedance": "eis"}, F.col("p_retailprice") > 905).select("source", "flag", "kind")


@query("""select p_partkey as source, 'particle_radius' as parameter, p_size * 1e-6 as value, true as known from part union all select p_partkey, 'Negative.other', p_retailprice, false from part""")
def op_import_blocks(t):
    values = F.create_map(F.lit("radius"), F.col("p_size").cast("double"), F.lit("other"), F.col("p_retailprice"))
    return importers.claims_from_blocks(t.part, F.col("p_partkey"), F.lit("Negative"), values, {"Negative.radius": "particle_radius"}, {"Negative.radius": "um"}, {"um": 1e-6})


@query("select p_partkey as id, 'brand' as holder, p_brand as name from part union all select p_partkey, 'type', p_type from part where p_size > 25")
def op_embedded(t):
    return importers.embedded(t.part, F.col("p_partkey"), {"brand": F.col("p_brand"), "type": F.when(F.col("p_size") > 25, F.col("p_type"))})


@query("""select * from (values (1, '0', 'cc', ''), (1, '1.0', 'cv', '3'), (1, '1.1', 'rest', '3'), (1, '2', 'eis', '')) v(program, path, mode, repeats)""")
def op_fold_loops(t):
    rows = t.values([(1, 0, "cc", None, None), (1, 1, "cv", None, None), (1, 2, "rest", None, None), (1, 3, "loop", 1, 3), (1, 4, "eis", None, None)], "program int, position int, mode string, target int, count int")
    return importers.folded(rows).select("program", "path", "mode", text_list(F.col("repeats")).alias("repeats"))


@query("select s_name, s_suppkey as cell from supplier")
def op_group_files(t):
    return importers.grouped_files(t.supplier.select("s_name"), "s_name", [r"(?i)(?:channel|ch)[-_]?0*(\d+)", r"#0*(\d+)$"])


# More scalar functions, links and rollups


@query("""select event_id, case event_id % 4 when 0 then 7 when 1 then 1704067200 when 3 then 1704067200 + event_id end as seconds, case when event_id % 4 = 2 then 'unparsable time' end as problem from events""")
def op_resolved_time(t):
    k = F.col("event_id") % 4
    text = F.when(k == 0, " ").when(k == 1, "2024-01-01T00:00:00Z").when(k == 2, "soon").otherwise((F.col("event_id") + 1704067200).cast("string"))
    r = scalars.resolved_time(text, F.lit(7))
    return t.events.select("event_id", r["seconds"].alias("seconds"), r["problem"].alias("problem"))


@query("select event_id, case event_type when 'click' then 'Galvanostatic cycling' when 'view' then 'Impedance' else event_type end as label from events")
def op_technique_labels(t):
    return t.events.select("event_id", scalars.mapped(F.col("event_type"), {"click": "Galvanostatic cycling", "view": "Impedance"}, F.col("event_type")).alias("label"))


@query("""select event_id, '{"body":{"v":' || event_id || '},"id":"' || event_type || '","list":[{},{"w":3}]}' as document from events""")
def op_without_volatile(t):
    text = F.concat(F.lit('{"id":"'), "event_type", F.lit('","created_at":5,"list":[{"created_at":1},{"w":3}],"body":{"retrieved_at":{"id":1},"v":'), "event_id", F.lit("}}"))
    return t.events.select("event_id", exports.without_volatile(text, ["created_at", "retrieved_at"]).alias("document"))


@query("select o_orderkey, case when o_orderkey % 3 > 0 then c.c_custkey end as customer_id from orders left join customer c on o_custkey = c.c_custkey")
def op_embedded_replaced(t):
    holders = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.format_string(" CUSTOMER#%09d", F.col("o_custkey"))).otherwise("nobody").alias("holder"))
    return references.holder_to_key(holders, "holder", t.customer, "c_name", "c_custkey", "customer_id")


@query("""select p_brand, p_type, p_partkey from (select *, row_number() over (partition by p_brand, p_type order by case when p_size < 10 then 0 else 1 end, p_partkey) as r from part) where r = 1""")
def op_merged_entities(t):
    columns = t.part.select("p_brand", "p_type", "p_partkey", "p_size")
    return records.merged_first(columns.where("p_size < 10").drop("p_size"), columns.where("p_size >= 10").drop("p_size"), ["p_brand", "p_type"], [F.col("p_partkey")])


@query("select p_partkey, p_type from part where p_type <> 'PROMO' and p_size > 3 order by p_partkey limit 12")
def op_import_limit(t):
    return records.first_usable(t.part.select("p_partkey", "p_type", "p_size"), (F.col("p_type") != "PROMO") & (F.col("p_size") > 3), [F.col("p_partkey")], 12).select("p_partkey", "p_type")


@query("""select user_id, case when count_if(event_type = 'error') > 5 then 'annotate' when count_if(event_type = 'click') > count_if(event_type = 'view') then 'submit' else 'done' end as next from events group by user_id""")
def op_next_command(t):
    status = rollups.status_pivot(t.events, "user_id", "event_type", ["click", "error", "view"])
    return status.select("user_id", rollups.next_step([(F.col("error") > 5, "annotate"), (F.col("click") > F.col("view"), "submit")], "done").alias("next"))


@query("""select l_orderkey, count(*) as wanted, cast(count_if(l_discount > 0.04) as bigint) as found, case when count_if(l_discount > 0.04) = 0 then 'none' when count_if(l_discount > 0.04) < count(*) then 'partial' else 'full' end as score
from lineitem group by l_orderkey""")
def op_recovery_score(t):
    counts = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("wanted"), F.count_if(F.col("l_discount") > 0.04).alias("found"))
    return counts.withColumn("score", rollups.recovery(F.col("found"), F.col("wanted")))


@query("""with f as (select s_suppkey, s_suppkey % 3 as k, substr(md5(s_name), 1, 6) as short from supplier), s as (select short, min(s_suppkey) as cell from f group by short)
select 'raw/' || case k when 0 then 'run-' || f.short || '.csv' when 1 then 'TEST_cell' || s_suppkey || '_01.nda' else 'other' || s_suppkey || '.csv' end as path, case k when 0 then cell when 1 then s_suppkey end as cell from f left join s on f.short = s.short""")
def op_file_cells(t):
    cells = t.supplier.select(F.col("s_suppkey").alias("cell"), F.substring(F.md5("s_name"), 1, 6).alias("short"), F.concat(F.lit("Cell"), "s_suppkey").alias("serial"))
    k = F.col("cell") % 3
    path = F.concat(F.lit("raw/"), F.when(k == 0, F.concat(F.lit("run-"), "short", F.lit(".csv"))).when(k == 1, F.concat(F.lit("TEST_cell"), "cell", F.lit("_01.nda"))).otherwise(F.concat(F.lit("other"), "cell", F.lit(".csv"))))
    return references.matched_files(cells.select(path.alias("path")), "path", cells, "cell", "short", "serial")


@query("""with v as (select n_regionkey * 10 + n_nationkey % 4 as class, n_name from nation) select class, case when count(distinct n_name) = 1 then min(n_name) end as n_name, count(distinct n_name) > 1 as ambiguous from v group by class""")
def op_inverse_vocabulary(t):
    return references.inverse(t.nation.select((F.col("n_regionkey") * 10 + F.col("n_nationkey") % 4).alias("class"), "n_name"), "n_name", "class")


@query("""select s_name as id, '{"attributes":{"titles":[{"title":"' || s_name || '"}],"creators":[{"name":"lab"}],"publicationYear":2024,"types":{"resourceTypeGeneral":"Dataset"},"rightsList":[{"rights":"cc-by-4.0"}]}}' as document from supplier""")
def op_datacite(t):
    return exports.datacite(t.supplier, F.col("s_name"), F.col("s_name"), F.lit(2024), F.lit("lab"), F.lit("cc-by-4.0"))


@query("""select page_id, case when ends_with(lower(url), '.html') then 'text/html' when ends_with(lower(url), '/') then 'inode/directory' else 'application/octet-stream' end as media from pages""")
def op_media_types(t):
    return t.pages.select("page_id", scalars.media_type(F.col("url"), {".html": "text/html", "/": "inode/directory"}).alias("media"))


@query("select page_id, replace(url, 'example', '***') as url from pages")
def op_redacted(t):
    return t.pages.select("page_id", scalars.without_secret(F.col("url"), "example").alias("url"))


@query("select p_partkey, case when p_size % 2 = 0 then replace(lower(p_type), 'ohms', 'ohm') else 'mah' end as unit from part")
def op_unit_tokens(t):
    return t.part.select("p_partkey", scalars.normalised_unit(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_type")), F.lit("mA h")).alias("unit"))


@query("select p_partkey, case when p_size % 3 = 0 and p_size % 2 = 0 then 'unknown' when p_size % 3 = 0 then p_brand when p_size % 2 = 0 then p_type else p_type || ' | ' || p_brand end as chemistry from part")
def op_chemistry_text(t):
    parts = F.when(F.col("p_size") % 3 != 0, F.col("p_type")), F.when(F.col("p_size") % 2 != 0, F.col("p_brand"))
    return t.part.select("p_partkey", scalars.joined(*parts, default="unknown").alias("chemistry"))


@query("select p_partkey, case when p_size % 2 = 0 then round(p_size / 100.0, 6) else cast(p_size as double) end as fraction, case when p_size % 2 = 0 then round(p_size / 1000.0, 6) else p_size / 10.0 end as spread from part")
def op_fraction_spread(t):
    size = F.col("p_size").cast("double")
    f = scalars.fraction_with_spread(size, size / 10, F.when(F.col("p_size") % 2 == 0, "%").otherwise("1"))
    return t.part.select("p_partkey", f["value"].alias("fraction"), f["std_dev"].alias("spread"))


@query("select coalesce(event_type, 'total') as kind, count(*) as n, cast(count_if(value < 20) as bigint) as n_failed from events group by rollup (event_type)")
def op_kind_outcomes(t):
    return rollups.outcomes(t.events, "event_type", F.col("value") < 20)


@query("select c_custkey, case when c_custkey % 3 > 0 then c_name || '::' || c_mktsegment else c_mktsegment end as seed from customer")
def op_natural_seeds(t):
    return t.customer.select("c_custkey", identity.seed_of(F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit(" "), "c_name")).otherwise(" "), F.col("c_mktsegment")).alias("seed"))


@query("select 'a/' || s_suppkey || '.csv' as path, case when s_suppkey % 3 = 0 then 'a/' || s_suppkey || '.bdf.parquet' end as converted from supplier")
def op_raw_converted(t):
    names = [F.concat(F.lit("a/"), "s_suppkey", F.lit(".csv")), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("a/"), "s_suppkey", F.lit(".bdf.parquet")))]
    return series.raw_with_converted(t.supplier.select(F.explode(F.array_compact(F.array(*names))).alias("path")))


# Documents, publications and the save chain


@query("""select event_id as id, 'value_not_finite' as code, 'error' as severity, case event_id % 4 when 1 then 'a.l[0].v' else 'a.x_at' end as path from events where event_id % 4 in (1, 3)
union all select event_id, 'timestamp_implausible', 'warning', 'a.x_at' from events where event_id % 4 in (0, 3)""")
def op_leaf_issues(t):
    k = F.col("event_id") % 4
    time = F.when(k == 0, "5").when(k == 1, "0").when(k == 2, "1704067200").otherwise("NaN")
    document = F.concat(F.lit('{"a":{"x_at":'), time, F.lit(',"l":[{"v":'), F.when(k == 1, "1e999").otherwise("3"), F.lit("},2]}}"))
    return rules.leaf_issues(t.events.select("event_id", document.alias("d")), "event_id", "d")


@query("""select n_nationkey as id, 'jsonld.type_term_unknown' as code, '@type[1]' as path from nation union all select n_nationkey, 'jsonld.id_not_portable', 'n.@id' from nation
union all select n_nationkey, 'jsonld.id_not_portable', '@id' from nation where n_nationkey % 2 = 1""")
def op_graph_text_issues(t):
    own = F.when(F.col("n_nationkey") % 2 == 1, F.col("n_name")).otherwise(F.concat(F.lit("x:"), "n_name"))
    document = F.concat(F.lit('{"@context":{"@type":"other"},"@id":"'), own, F.lit('","@type":["Known","'), "n_name", F.lit('"],"n":{"@id":"c1","@type":"x:Y"}}'))
    return rules.graph_text_issues(t.nation.select("n_nationkey", document.alias("d")), "n_nationkey", "d", ["Known"], True).select("id", "code", "path")


@query("""select p_partkey as id, 'mystery' as property, 'property_unmapped' as code from part union all select p_partkey, 'capacity', 'value_text_only' from part where p_size % 2 = 1
union all select p_partkey, 'nominal_capacity', 'property_alias_collision' from part where p_size % 3 = 0""")
def op_mappability(t):
    row = lambda pos, name, number, text: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("property"), number.alias("number"), F.lit(text).alias("text"))
    price = F.col("p_retailprice")
    made = F.array(row(0, "capacity", F.when(F.col("p_size") % 2 == 0, price), "x"), row(1, "mystery", price, "x"), row(2, "loading", price, "x"))
    made = F.when(F.col("p_size") % 3 == 0, F.concat(made, F.array(row(3, "nominal_capacity", price, "x")))).otherwise(made)
    classes = t.values([("capacity", "Capacity"), ("nominal_capacity", "Capacity")], "property string, class string")
    return rules.mappability(t.part.select(F.col("p_partkey").alias("id"), F.inline(made)), classes, ["loading"])


@query("""with p as (select p_partkey, p_size % 5 as k, p_partkey % 2 as odd from part) select p_partkey as id, case k when 0 then 'electrode_kind_missing' when 2 then 'electrode_kind_not_active' when 3 then 'electrode_kind_unknown' else 'electrode_polarity_conflict' end as code,
case k when 3 then 'error' else 'warning' end as severity from p where k in (0, 2, 3) or (k = 1 and odd = 1) or (k = 4 and odd = 0)""")
def op_electrode_kinds(t):
    k = F.col("p_size") % 5
    kind = F.when(k == 0, " ").when(k == 1, "Graphite").when(k == 2, "PVDF").when(k == 3, "unobtainium").otherwise("LFP ")
    polarity = F.when(F.col("p_partkey") % 2 == 0, "negative").otherwise("positive")
    made = schema.electrode_kind_rules(kind, polarity, {"graphite": "negative", "lfp": "positive", "pvdf": None})
    return rules.issues(t.part, "p_partkey", made).select("id", "code", "severity")


@query("""with p as (select p_partkey as id, p_partkey % 6 as k, p_size from part) select id, 'publication.' || code as code, severity, path from (
select id, 'dataset_about_missing' as code, 'error' as severity, '@graph[0].schema:about' as path from p where k = 0
union all select id, 'reference_missing_node', 'error', '@graph[0].schema:about[0].@id' from p where k in (1, 5) union all select id, 'dataset_distribution_missing', 'error', '@graph[0].schema:distribution' from p where k = 2
union all select id, 'distribution_missing_field', 'error', '@graph[0].schema:distribution[0]' from p where k = 3 union all select id, 'distribution_url_invalid', 'error', '@graph[0].schema:distribution[0].schema:contentUrl' from p where k = 3
union all select id, 'distribution_checksum_invalid', 'error', '@graph[0].schema:distribution[0].schema:sha256' from p where k = 4 union all select id, 'distribution_parent_invalid', 'error', '@graph[0].schema:distribution[0].schema:isPartOf' from p where k = 4
union all select id, 'duplicate_node_id', 'error', '@graph[1].@id' from p where k = 5 union all select id, 'license_missing', 'warning', '@graph[2]' from p where p_size % 2 = 1)""")
def op_publication_issues(t):
    k, key = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    link = lambda c: F.struct(c.alias("@id"))
    data, cell = F.concat(F.lit("https://x.org/dataset/"), key), F.concat(F.lit("https://x.org/cell/"), key)
    file = F.struct(
        F.when(k == 3, "nowhere").otherwise("https://x.org/f.csv").alias("schema:contentUrl"), F.when(k != 3, "text/csv").alias("schema:encodingFormat"),
        link(F.when(k == 4, "local").otherwise(data)).alias("schema:isPartOf"), F.when(k == 4, "abc").otherwise(F.sha2(key, 256)).alias("schema:sha256"),
    )
    node = lambda identifier, kind, about=None, files=None, licence=None: F.struct(
        identifier.alias("@id"), F.lit(kind).alias("@type"), (F.lit(None).cast("array<struct<`@id`:string>>") if about is None else about).alias("schema:about"),
        (F.when(F.lit(False), F.array(file)) if files is None else files).alias("schema:distribution"), (F.lit(None).cast("string") if licence is None else licence).alias("schema:license"))
    graph_ = F.array(
        node(data, "schema:Dataset", F.when(k != 0, F.array(link(F.when(k == 1, "https://x.org/cell/none").otherwise(cell)))), F.when(k == 2, F.slice(F.array(file), 1, 0)).otherwise(F.array(file))),
        node(F.when(k == 5, data).otherwise(cell), "Cell"), node(F.lit("https://x.org/catalog"), "dcat:Catalog", licence=F.when(F.col("p_size") % 2 == 0, "mit")),
    )
    return publication.issues(t.part.select("p_partkey", F.to_json(F.struct(graph_.alias("@graph"))).alias("d")), "p_partkey", "d", "https://x.org/", "https://x.org/dataset/")


@query("""select 'https://x.org/n/' || n_nationkey as s, '<https://x.org/n/' || n_nationkey || '> a <https://x.org/Nation> ;' || chr(10) || '    <https://x.org/name> "' || n_name || '" ;' || chr(10) || '    <https://x.org/region> <https://x.org/r/' || n_regionkey || '> .' as value from nation""")
def op_turtle(t):
    made = graph.triples(t.nation, F.concat(F.lit("https://x.org/n/"), "n_nationkey"), "https://x.org/Nation", {"https://x.org/name": F.col("n_name")}, {"https://x.org/region": F.concat(F.lit("https://x.org/r/"), "n_regionkey")})
    return graph.turtle(made)


@query("""select 'e/' || event_id as id, event_type as kind, '{"@context":"c","@id":"e/' || event_id || '",' || case event_type when 'click' then '"@type":["Click"],"user":' || user_id else '"@type":["View","Seen"],"who":"view"' end || ',"license":"mit"}' as document
from events where event_type in ('click', 'view')""")
def op_json_ld_kinds(t):
    shapes = {"click": (["Click"], {"user": F.col("user_id")}), "view": (["View", "Seen"], {"who": F.col("event_type")})}
    return graph.json_ld_by_kind(t.events, F.concat(F.lit("e/"), "event_id"), F.col("event_type"), shapes, "c", {"license": F.lit("mit")})


@query("""select c_custkey as id, case when c_custkey % 5 = 0 then 'reference.missing' else 'name_mismatch' end as code, case when c_custkey % 5 > 0 then n_name end as found from customer join nation on c_nationkey = n_nationkey where c_custkey % 5 = 0 or c_custkey % 3 = 0""")
def op_disagreeing(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey")).alias("nation"), F.when(F.col("c_custkey") % 3 == 0, "Atlantis").otherwise(" ").alias("stated"))
    return references.disagreeing(rows, "c_custkey", "nation", "stated", t.nation, "n_nationkey", "n_name")


_SAVED = """select p_partkey, p_retailprice, p_partkey % 3 = 0 as old, case when p_size > 45 then 'invalid'
when p_size % 4 = 0 and p_partkey + 7 not in (select p_partkey from part where p_size <= 45 or p_partkey % 3 = 0) then 'reference' end as problem from part"""


def _save(t):
    price = F.col("p_retailprice")
    incoming = t.part.select("p_partkey", "p_retailprice")
    stored = t.part.where("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, price).otherwise(price + 1).alias("p_retailprice"))
    errors = t.part.where("p_size > 45").select(F.col("p_partkey").alias("id"))
    links = t.part.where("p_size % 4 = 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") + 7).alias("target"))
    return incoming, stored, records.save_outcomes(incoming, stored, "p_partkey", ["p_retailprice"], errors, links)


@query(f"select p_partkey, problem, case when problem is not null then 'failed' when not old then 'created' when p_partkey % 2 = 0 then 'exists' else 'updated' end as status from ({_SAVED})")
def op_save_outcomes(t):
    return _save(t)[2]


@query(f"select p_partkey, case when problem is not null and p_partkey % 2 = 1 then p_retailprice + 1 else p_retailprice end as p_retailprice from ({_SAVED}) where old or problem is null")
def op_saved(t):
    incoming, stored, outcomes = _save(t)
    return records.saved(incoming, stored, "p_partkey", outcomes)


@query("select c_custkey, c_name from customer where c_acctbal >= 0")
def op_promoted(t):
    found = rules.issues(t.customer, "c_custkey", [rules.Rule("low", "error", "c_acctbal", F.col("c_acctbal") < 0, "below zero"), rules.Rule("high", "warning", "c_acctbal", F.col("c_acctbal") > 5000, "much")])
    return records.promoted(t.customer.select("c_custkey", "c_name"), "c_custkey", found)


@query("select l_returnflag, count(l_quantity) as n, round(avg(l_quantity), 4) as mean, round(stddev_samp(l_quantity), 4) as std_dev from lineitem group by l_returnflag")
def op_statistics(t):
    return rollups.statistics(t.lineitem, "l_returnflag", F.col("l_quantity"), 4)


@query("select 'test/' || user_id as id, 'cycling' as kind, cast(floor(epoch(min(ts))) as bigint) as started_at, cast(floor(epoch(max(ts))) as bigint) as ended_at from events group by user_id")
def op_series_tests(t):
    return series.as_records(t.events, "user_id", "ts", "cycling")[0]


@query("select 'dataset/' || user_id as id, 'test/' || user_id as test_id, count(*) as n_rows, 'event_id,' || case when count_if(event_type = 'error') > 0 then 'failed,' else '' end || 'value' as variables from events group by user_id")
def op_series_datasets(t):
    rows = t.events.select("user_id", "ts", "event_id", "value", F.when(F.col("event_type") == "error", 1).alias("failed"))
    return series.as_records(rows, "user_id", "ts", "cycling")[1].withColumn("variables", text_list(F.col("variables")))


@query("select p_partkey, p_name from part where p_type = 'SMALL'")
def op_category(t):
    return t.part.where(P.equals(F.col("p_type"), "SMALL")).select("p_partkey", "p_name")


# Beyond the record engine: what Spark's own operators add


@query("""select coalesce(o_orderstatus, 'all') as status, coalesce(o_orderpriority, 'all') as priority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)""")
def op_bonus_rollup(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n")


@query("""select user_id, date_trunc('hour', ts) as hour, count(*) as n from events group by all""")
def op_bonus_windows(t):
    return t.events.groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
