"""The procurement tables as views of a star schema of orders.

Operators take the tables of ``schemas.TABLES`` from anywhere; this lens derives
them from `orders`, `lineitem` and their dimensions, so that every operator has
data. Orders whose key is divisible by 8 have no tender row: their bids and awards
are orphans, as happens in published data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.deploy import ship


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _month(c: str) -> Column:
    return F.date_format(c, "yyyyMM")


class Lens:
    """The canonical tables, each read when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        ship(spark)

    def raw(self, name: str) -> DataFrame:
        """A table of the star schema."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tender(self) -> DataFrame:
        orders = self.raw("orders").filter("o_orderkey % 8 <> 0")
        c = self.raw("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        return orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            _text("o_orderkey").alias("nro_sicop"),
            F.concat(F.lit("P-"), _text("o_orderkey")).alias("nro_procedimiento"),
            _text("c_nationkey").alias("cedula_institucion"),
            _day("o_orderdate").alias("fecha_publicacion"),
            F.date_format(F.date_add("o_orderdate", 15), "yyyy-MM-dd").alias("fechah_apertura"),
            F.when(priority == "1-URGENT", "EXCEPCION").otherwise("LICITACION").alias("tipo_procedimiento"),
            F.lit("Cantidad definida").alias("modalidad"),
            F.when(status == "F", "Contrato").when(status == "O", "En evaluación").otherwise("Desierto").alias("cartel_stat"),
            F.col("c_mktsegment").alias("cartel_nm"),
            F.col("o_totalprice").alias("monto_est"),
            F.when(F.col("c_mktsegment") == "BUILDING", "OBRA").otherwise("BIENES").alias("clas_obj"),
            F.when(priority.isin("5-LOW", "1-URGENT", "3-MEDIUM"), F.substring(priority, 1, 1)).alias("cod_excepcion"),
            F.when(priority == "5-LOW", "escasa cuantía").when(priority == "1-URGENT", "Proveedor único").alias("des_excepcion"),
            F.lit(None).cast("string").alias("fecha_mod"),
            _month("o_orderdate").alias("source_month"),
            F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("T000000Z")).alias("archive_stamp"),
        )

    @cached_property
    def bid(self) -> DataFrame:
        rows = self.raw("lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_shipdate").alias("first"))
        return rows.select(
            _text("l_orderkey").alias("nro_sicop"), _text("l_suppkey").alias("nro_oferta"), _text("l_suppkey").alias("cedula_proveedor"),
            _day("first").alias("fecha_presenta"), F.lit("Base").alias("tipo_oferta"),
            F.when(F.col("l_suppkey") % 10 == 0, F.concat(F.lit("C"), _text(F.col("l_suppkey") % 4))).alias("id_consorcio"),
            _month("first").alias("source_month"), F.concat(F.date_format("first", "yyyyMMdd"), F.lit("T000000Z")).alias("archive_stamp"),
        )

    def _lines(self, df: DataFrame, *more: Column) -> DataFrame:
        return df.select(
            _text("l_orderkey").alias("nro_sicop"), *more, _text("l_linenumber").alias("nro_linea"), _text("l_partkey").alias("codigo_producto"),
            F.col("l_quantity").alias("cantidad"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("precio_unitario"),
            F.when(F.col("l_linestatus") == "F", "CRC").otherwise("USD").alias("moneda"), _month("l_shipdate").alias("source_month"),
        )

    @cached_property
    def bid_line(self) -> DataFrame:
        return self._lines(self.raw("lineitem"), _text("l_suppkey").alias("nro_oferta"))

    @cached_property
    def award_line(self) -> DataFrame:
        rows = self.raw("lineitem").filter("l_returnflag = 'R'")
        return self._lines(rows, F.lit("1").alias("nro_oferta"), _text("l_suppkey").alias("nro_acto"), _text("l_suppkey").alias("cedula_proveedor"))

    @cached_property
    def contract(self) -> DataFrame:
        rows = self.raw("lineitem").filter("l_returnflag = 'A'")
        return rows.select(
            _text("l_orderkey").alias("nro_contrato"), _text("l_linenumber").alias("secuencia"), _text("l_orderkey").alias("nro_sicop"),
            F.concat(F.lit("P-"), _text("l_orderkey")).alias("nro_procedimiento"), _text("l_suppkey").alias("cedula_proveedor"),
            _day("l_shipdate").alias("fecha_notificacion"), F.when(F.col("l_linestatus") == "F", "CRC").otherwise("USD").alias("moneda"),
            _month("l_shipdate").alias("source_month"), F.concat(F.date_format("l_shipdate", "yyyyMMdd"), F.lit("T000000Z")).alias("archive_stamp"),
        )

    @cached_property
    def stage_dates(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
        done = F.col("l_linestatus") == "F"
        return self.raw("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
            _text("l_orderkey").alias("nro_sicop"), F.lit("00").alias("cartel_seq"), F.lit("1").alias("partida"), _text("l_linenumber").alias("linea"),
            F.concat(F.lit("P-"), _text("l_orderkey")).alias("nro_procedimiento"), _day("o_orderdate").alias("publicacion"),
            F.date_format(F.date_add("o_orderdate", 15), "yyyy-MM-dd").alias("fecha_apertura"),
            F.when(done, _day("l_shipdate")).alias("adjudicacion_firme"),
            F.when(done, F.date_format(F.date_add("l_shipdate", F.col("l_linenumber")), "yyyy-MM-dd")).alias("fecha_elaboracion_contrato"),
            F.when(done & (F.col("l_returnflag") == "R"), F.date_format(F.date_add("l_shipdate", F.lit(30) + F.col("l_linenumber")), "yyyy-MM-dd")).alias("fecha_1ra_sol_pago"),
            F.when(done & (F.col("l_returnflag") != "N"), F.date_format(F.date_add("l_shipdate", F.lit(60) + F.col("l_linenumber")), "yyyy-MM-dd")).alias("fecha_resul_pago"),
            _month("l_shipdate").alias("source_month"),
        )

    @cached_property
    def supplier(self) -> DataFrame:
        return self.raw("supplier").select(_text("s_suppkey").alias("cedula_proveedor"), F.col("s_name").alias("nombre"), _text("s_nationkey").alias("zona_geo"))

    @cached_property
    def institution(self) -> DataFrame:
        return self.raw("nation").select(_text("n_nationkey").alias("cedula"), F.col("n_name").alias("nombre"), _text("n_regionkey").alias("zona_geo"))

    @cached_property
    def appeal(self) -> DataFrame:
        e = self.raw("events").filter("event_type = 'error'")
        kind = F.col("event_id") % 4
        return e.select(
            _text(F.col("event_id") - F.col("event_id") % 2).alias("nro_recurso"), _text("event_id").alias("linea_objetada"), _text(F.col("user_id") % 100).alias("cedula_proveedor"),
            F.when(kind == 0, "Con lugar").when(kind == 1, "Sin lugar").when(kind == 2, " Parcialmente con lugar").alias("resultado"), _day("ts").alias("fecha_presentacion"),
        )

    @cached_property
    def sanction(self) -> DataFrame:
        return self.raw("supplier").filter("s_acctbal < 0").select(_text("s_suppkey").alias("cedula_proveedor"), F.lit("Inhabilitación").alias("tipo_sancion"), F.lit("2020-01-01").alias("inicio_sancion"), F.lit("Firme").alias("estado"))
