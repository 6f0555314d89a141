"""The given tables in the shapes of the warehouse: page logs, orders, payments, dimensions, change records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemart import schemas
from tidemart.functions import order
from tidemart.sources.handover import Chunks


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # Logs -------------------------------------------------------------------------------------------------------------

    def event_rows(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("bigint")
        return self.events.withColumns({"k": k, "et": F.col("ts").cast("timestamp")}).withColumn("ms", F.unix_millis("et"))

    def page_logs(self, *more: str) -> DataFrame:
        """common, page, start, displays, ts and event_id, a unique id of the record; more: columns of event_rows()."""
        kind = F.col("event_type")

        def by_kind(**values: Column) -> Column:
            out = F.lit(None).cast("string")
            for name, v in values.items():
                out = F.when(kind == name, v).otherwise(out)
            return out

        text = F.lit
        page = F.struct(
            by_kind(view=text("home"), signup=text("home"), click=text("good_detail"), error=text("good_list"), purchase=text("trade")).alias("page_id"),
            by_kind(signup=text(""), click=text("good_list"), error=text("search"), purchase=text("cart")).alias("last_page_id"),
            by_kind(click=F.col("k").cast("string"), error=F.concat(F.lit("red widget "), F.col("k").cast("string"))).alias("item"),
            by_kind(click=text("sku_id"), error=text("keyword")).alias("item_type"),
            F.floor(F.col("value") * 1000).alias("during_time"),
        )
        show = lambda j: F.struct(
            (F.col("k") + j).cast("string").alias("item"), F.when((F.col("k") + j) % 2 == 0, "sku_id").otherwise("activity").alias("item_type")
        )
        common = F.struct(
            F.col("user_id").cast("string").alias("mid"), *[(F.col("user_id") % m).cast("string").alias(c) for c, m in (("vc", 3), ("ch", 5), ("ar", 7))],
            F.when(kind == "signup", "1").otherwise("0").alias("is_new"),
        )
        start = F.when(F.col("event_id") % 11 == 0, F.struct(F.lit("icon").alias("entry"), F.col("k").alias("loading_time")))
        return self.event_rows().select(
            common.alias("common"), page.alias("page"), start.alias("start"),
            F.transform(F.sequence(F.lit(0), (F.col("k") % 3).cast("int")), show).alias("displays"), F.col("ms").alias("ts"), "event_id", *more,
        )

    def raw_logs(self) -> DataFrame:
        """value: page logs as JSON; every 97th is broken."""
        broken = F.when(F.col("event_id") % 194 == 0, F.lit("{bad")).when(F.col("event_id") % 97 == 0, F.lit("123"))
        return self.page_logs().select(F.coalesce(broken, F.to_json(F.struct("common", "page", "start", "displays", "ts", "event_id"))).alias("value"))

    # Orders -----------------------------------------------------------------------------------------------------------

    @staticmethod
    def money(x: Column) -> Column:
        """Rounded to cents as whole numbers first: the same on any engine."""
        return (F.floor(x * 100 + 0.5).cast("decimal(16,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(schemas.MONEY)

    def order_infos(self) -> DataFrame:
        province = self.customer.select("c_custkey", F.col("c_nationkey").cast("bigint").alias("province_id"))
        o = self.orders.join(province, F.col("o_custkey") == F.col("c_custkey"))
        none = F.lit(None).cast(schemas.MONEY)
        return o.select(
            F.col("o_orderkey").alias("id"), "province_id", F.col("o_orderstatus").alias("order_status"), F.col("o_custkey").alias("user_id"),
            self.money(F.col("o_totalprice")).alias("total_amount"), *[none.alias(c) for c in ("activity_reduce_amount", "coupon_reduce_amount")],
            self.money(F.col("o_totalprice")).alias("original_total_amount"), none.alias("feight_fee"), F.lit(None).cast("string").alias("expire_time"),
            F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("create_time"), F.lit(None).cast("string").alias("operate_time"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("create_date"), F.date_format("o_orderdate", "HH").alias("create_hour"),
            F.col("o_orderdate").cast("timestamp").alias("et"),
        )

    def worth(self) -> Column:
        return self.money(F.col("l_extendedprice") * (1 - F.col("l_discount")))

    def order_details(self) -> DataFrame:
        none = F.lit(None).cast(schemas.MONEY)
        return self.lineitem.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku_id"),
            self.money(F.col("l_extendedprice")).alias("order_price"), F.col("l_quantity").cast("bigint").alias("sku_num"),
            F.lit(None).cast("string").alias("sku_name"), self.worth().alias("split_total_amount"), none.alias("split_activity_amount"),
            none.alias("split_coupon_amount"), F.col("l_shipdate").cast("timestamp").alias("et"),
        )

    def payments(self) -> DataFrame:
        paid = F.col("o_orderdate").cast("timestamp") + F.make_interval(mins=(F.col("o_orderkey") % 20).cast("int"))
        return self.orders.where("o_orderstatus = 'F'").select(
            F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
            self.money(F.col("o_totalprice")).alias("total_amount"), F.lit("goods").alias("subject"), F.col("o_orderpriority").alias("payment_type"),
            F.date_format(paid, "yyyy-MM-dd HH:mm:ss").alias("create_time"), F.lit(None).cast("string").alias("callback_time"), paid.alias("et"),
        )

    def favors(self) -> DataFrame:
        return self.event_rows().where("event_type = 'signup'").select((F.col("event_id") % 200).alias("sku_id"), "et")

    def carts(self) -> DataFrame:
        return self.event_rows().where("event_type = 'purchase'").select((F.col("event_id") % 200).alias("sku_id"), (F.col("k") % 5 + 1).alias("sku_num"), "et")

    def comments(self) -> DataFrame:
        code = F.concat(F.lit("120"), (F.col("k") % 3 + 1).cast("string"))
        return self.event_rows().where("event_type = 'error'").select((F.col("event_id") % 200).alias("sku_id"), code.alias("appraise"), "et")

    def refunds(self) -> DataFrame:
        back = self.lineitem.where("l_returnflag = 'R'")
        return back.select(F.col("l_partkey").alias("sku_id"), F.col("l_orderkey").alias("order_id"), self.worth().alias("refund_amount"), F.col("l_shipdate").cast("timestamp").alias("et"))

    # Dimensions, all strings ------------------------------------------------------------------------------------------

    def dims(self) -> dict[str, DataFrame]:
        text = lambda c, n: F.col(c).cast("string").alias(n) if isinstance(c, str) else c.cast("string").alias(n)
        part = self.part
        spu, tm = F.col("p_partkey") % 50, F.substring_index("p_brand", "#", -1)
        born = F.date_format(F.date_add(F.lit("1960-01-01").cast("date"), (F.col("c_custkey") % 15000).cast("int")), "yyyy-MM-dd")
        return {
            "user": self.customer.select(text("c_custkey", "ID"), born.alias("BIRTHDAY"), F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F").alias("GENDER")),
            "province": self.nation.select(
                text("n_nationkey", "ID"), F.col("n_name").alias("NAME"), text(F.col("n_nationkey") + 100000, "AREA_CODE"),
                F.concat(F.lit("N-"), F.col("n_nationkey").cast("string")).alias("ISO_CODE"), F.concat(F.lit("R-"), F.col("n_regionkey").cast("string")).alias("ISO_3166_2"),
            ),
            "sku": part.select(
                text("p_partkey", "ID"), F.col("p_name").alias("SKU_NAME"), text("p_size", "CATEGORY3_ID"), text(spu, "SPU_ID"), tm.alias("TM_ID"), text("p_retailprice", "PRICE")
            ),
            "spu": part.select(text(spu, "ID"), F.concat(F.lit("spu "), spu.cast("string")).alias("SPU_NAME")).distinct(),
            "trademark": part.select(tm.alias("ID"), F.col("p_brand").alias("TM_NAME")).distinct(),
            "category3": part.select(text("p_size", "ID"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("NAME")).distinct(),
        }

    # Changes ----------------------------------------------------------------------------------------------------------

    def raw_changes(self) -> DataFrame:
        """topic, value: change records of orders and customers; operations by the key."""
        op = lambda c: F.element_at(F.array(*map(F.lit, ("c", "u", "d", "r"))), (F.col(c) % 4).cast("int") + 1).alias("op")
        o = self.orders.select(
            F.lit("mysql.shop.order_info").alias("topic"),
            F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("note")).alias("after"), op("o_orderkey"),
        )
        c = self.customer.select(
            F.lit("mysql.shop.user_info").alias("topic"),
            F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("after"), op("c_custkey"),
        )
        as_json = lambda df: df.select("topic", F.to_json(F.struct("after", "op")).alias("value"))
        return as_json(o).unionByName(as_json(c))

    def positioned_changes(self) -> DataFrame:
        """topic, value: updates of customers with their places in twelve log files, in no order; every third comes twice."""
        key = F.col("o_orderkey")
        source = F.struct(F.concat(F.lit("bin."), (key * 7919 % 12 + 1).cast("string")).alias("file"), (key * 10).alias("pos"), F.lit(0).alias("row"))
        # Fields that are null aren't written: a partial update.
        after = F.struct(
            F.col("o_custkey").cast("string").alias("id"), F.when(key % 2 == 0, F.col("o_orderstatus")).alias("status"), F.when(key % 3 != 0, F.col("o_orderpriority")).alias("priority")
        )
        rows = self.orders.select(after.alias("after"), source.alias("source"), key.alias("key"))
        rows = rows.withColumn("time", F.explode(F.expr("sequence(1, if(key % 3 = 0, 2, 1))")))
        return rows.select(F.lit("mysql.shop.user_info").alias("topic"), F.to_json(F.struct("after", "source", F.lit("u").alias("op"))).alias("value"))

    def order_log(self) -> DataFrame:
        """id, seq, type, part: a table's log. Each line of an order is a change of it, the seventh deletes it; positions run over all orders line by line."""
        at = order.position(0, "", F.col("l_linenumber").cast("bigint") * 10_000_000 + F.col("l_orderkey"), F.col("l_partkey"))
        kind = F.when(F.col("l_linenumber") == 7, "delete").when(F.col("l_linenumber") == 1, "insert").otherwise("update")
        return self.lineitem.select(F.col("l_orderkey").alias("id"), at.alias("seq"), kind.alias("type"), F.col("l_partkey").alias("part"))

    def order_load(self, chunks: Chunks) -> tuple[DataFrame, DataFrame]:
        """(rows with chunk, marks): that table, loaded while it changed. Each row is as it was at some time between its chunk's marks."""
        low = (F.lit(1) + F.col("chunk") % 6) * 10_000_000 + F.col("chunk") * 1000
        bounds = [low, low + 12_000_000]
        marks = self.spark.range(len(chunks)).select(F.col("id").cast("int").alias("chunk")).withColumns({"low": order.numbered(bounds[0]), "high": order.numbered(bounds[1])})
        log = self.order_log().withColumn("chunk", chunks.of(F.col("id")))
        seen = bounds[0] + F.col("id") * 7919 % 12_000_000
        last = log.where(F.col("seq.pos") <= seen).groupBy("id", "chunk").agg(F.max_by(F.struct("type", "part"), "seq").alias("r"))
        return last.where("r.type <> 'delete'").select("id", "chunk", "r.part"), marks

    def routing(self) -> DataFrame:
        names = ", ".join(x.split()[0] for x in schemas.ROUTING.split(", "))
        none = "CAST(NULL AS STRING)"
        rows = f"""('order_info', 'insert', 'kafka', 'dwd_order_info', 'id,status', {none}, {none}),
            ('order_info', 'update', 'kafka', 'dwd_order_info_update', 'id,status,missing', {none}, {none}),
            ('user_info', 'insert', 'hbase', 'dim_user_info', 'id,name', 'id', {none})"""
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")
