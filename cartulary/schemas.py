"""Table schemas, key registries and the constants of the data model."""

from __future__ import annotations

from dataclasses import dataclass, field

# The longitudinal index. Ids and dates are text, amounts are doubles.
TABLES: dict[str, str] = {
    "tender": "nro_sicop string, nro_procedimiento string, cedula_institucion string, fecha_publicacion string, fechah_apertura string, tipo_procedimiento string, modalidad string, cartel_stat string, cartel_nm string, monto_est double, clas_obj string, cod_excepcion string, des_excepcion string, fecha_mod string, source_month string, archive_stamp string",
    "bid": "nro_sicop string, nro_oferta string, cedula_proveedor string, fecha_presenta string, tipo_oferta string, id_consorcio string, source_month string, archive_stamp string",
    "bid_line": "nro_sicop string, nro_oferta string, nro_linea string, codigo_producto string, cantidad double, precio_unitario double, moneda string, source_month string",
    "award_line": "nro_sicop string, nro_oferta string, nro_linea string, nro_acto string, cedula_proveedor string, codigo_producto string, cantidad double, precio_unitario double, moneda string, source_month string",
    "contract": "nro_contrato string, secuencia string, nro_sicop string, nro_procedimiento string, cedula_proveedor string, cedula_institucion string, tipo_contrato string, tipo_modificacion string, fecha_notificacion string, fecha_elaboracion string, moneda string, vigencia string, fecha_modificacion string, source_month string, archive_stamp string",
    "stage_dates": "nro_sicop string, cartel_seq string, partida string, linea string, nro_procedimiento string, publicacion string, fecha_apertura string, adjudicacion_firme string, fecha_notificacion string, fecha_elaboracion_contrato string, fecha_1ra_sol_pago string, fecha_ult_sol_pago string, fecha_resul_pago string, source_month string",
    "appeal": "nro_recurso string, linea_objetada string, cedula_proveedor string, nro_sicop string, nro_acto string, tipo_recurso string, resultado string, causa_resultado string, fecha_presentacion string, nro_procedimiento string, recurso_stat string, source_month string",
    "supplier": "cedula_proveedor string, nombre string, tipo string, tamano string, zona_geo string, fecha_constitucion string, source_month string",
    "institution": "cedula string, nombre string, zona_geo string, fecha_ingreso string, source_month string",
    "sanction": "cedula_proveedor string, cedula_institucion string, no_resolucion string, codigo_producto string, tipo_sancion string, descr_sancion string, inicio_sancion string, final_sancion string, estado string, source_month string",
    "inhibition": "ced_institucion string, ced_funcionario string, nom_funcionario string, fecha_inicio string, fecha_fin string, estado string, source_month string",
    "entity": "entity_id string, canonical_name string, kind string, member_count int, evidence string",
    "entity_member": "entity_id string, cedula_proveedor string, role string",
    "loaded_archive": "source_month string, archive_stamp string, sha256 string, loaded_at string, row_counts string",
}

# Columns that name a row of the index; the newest source month wins for each.
INDEX_KEYS: dict[str, tuple[str, ...]] = {
    "tender": ("nro_sicop",),
    "bid": ("nro_sicop", "nro_oferta"),
    "bid_line": ("nro_sicop", "nro_oferta", "nro_linea"),
    "award_line": ("nro_sicop", "nro_oferta", "nro_linea", "nro_acto"),
    "contract": ("nro_contrato", "secuencia"),
    "stage_dates": ("nro_sicop", "cartel_seq", "partida", "linea"),
    "appeal": ("nro_recurso", "linea_objetada"),
    "supplier": ("cedula_proveedor",),
    "institution": ("cedula",),
    "sanction": ("cedula_proveedor", "cedula_institucion", "no_resolucion", "codigo_producto"),
    "inhibition": ("ced_institucion", "ced_funcionario", "fecha_inicio"),
}
# Tables whose missing key parts count as the empty string instead of making the row unusable.
COALESCED_KEYS = frozenset({"sanction", "inhibition"})

# The published table of each index table, and the headers of its columns where they aren't the column's name in capitals.
INDEX_SOURCES: dict[str, tuple[str, dict[str, tuple[str, ...]]]] = {
    "tender": ("DetalleCarteles", {"modalidad": ("MODALIDAD_PROCEDIMIENTO",)}),
    "bid": ("Ofertas", {"fecha_presenta": ("FECHA_PRESENTA_OFERTA",)}),
    "bid_line": ("LineasOfertadas", {"cantidad": ("CANTIDAD_OFERTADA",), "precio_unitario": ("PRECIO_UNITARIO_OFERTADO",), "moneda": ("TIPO_MONEDA",)}),
    "award_line": ("LineasAdjudicadas", {"cantidad": ("CANTIDAD_ADJUDICADA",), "precio_unitario": ("PRECIO_UNITARIO_ADJUDICADO",), "moneda": ("TIPO_MONEDA",)}),
    "contract": ("Contratos", {"nro_procedimiento": ("NUMERO_PROCEDIMIENTO", "NRO_PROCEDIMIENTO")}),
    "stage_dates": ("FechaPorEtapas", {"nro_procedimiento": ("NUMERO_PROCEDIMIENTO", "NRO_PROCEDIMIENTO")}),
    "appeal": ("RecursosObjecion", {"fecha_presentacion": ("FECHA_PRESENTACION_RECURSO",), "nro_procedimiento": ("NRO_PROCEDIMIENTO", "NUMERO_PROCEDIMIENTO")}),
    "supplier": ("Proveedores", {"nombre": ("NOMBRE_PROVEEDOR",), "tipo": ("TIPO_PROVEEDOR",), "tamano": ("TAMAÑO_PROVEEDOR", "TAMANO_PROVEEDOR"), "zona_geo": ("ZONA_GEO_PROV",)}),
    "institution": ("InstitucionesRegistradas", {"nombre": ("NOMBRE_INSTITUCION",), "zona_geo": ("ZONA_GEO_INST",)}),
    "sanction": ("SancionProveedores", {}),
    "inhibition": ("FuncionariosInhibicion", {}),
}
#: Columns with dates, and those whose dates may be eight digits, day first.
DATE_COLUMNS = ("publicacion", "adjudicacion_firme")
COMPACT_DATES = frozenset({"fecha_constitucion", "inicio_sancion", "final_sancion"})

# Status texts of the publisher, in its own wording.
AWARDED_STATUS = ("Contrato", "Adjudicado", "Adjudicación", "Acto Final en Firme", "Adjudicación en firme", "Finiquitado")
NO_AWARD_STATUS = ("Desierto", "Infructuoso", "Desierto/Infructuoso")
ANNULLED_STATUS = ("Sin efecto", "Nulidad absoluta")
IN_PROGRESS_STATUS = ("Publicado", "En recepción de ofertas", "En apertura", "En evaluación", "Objetado", "Apelación o Revocación")
#: Day on which the procurement law changed what counts as an exception.
REGIME_DATE = "2022-12-01"

# Legal forms that company names carry, longest wording first.
LEGAL_FORMS = (
    "SOCIEDAD ANONIMA DEPORTIVA", "SOCIEDAD ANONIMA", "SOCIEDAD DE RESPONSABILIDAD LIMITADA",
    "SOCIEDAD RESPONSABILIDAD LIMITADA", "RESPONSABILIDAD LIMITADA", "SOCIEDAD DE ACTIVIDADES PROFESIONALES",
    "LIMITADA", "LTDA", "S R L", "SRL", "S A", "SA", "LLC", "INC",
)

# Kinds of change between two copies of a period.
CHANGE_KINDS = ("added", "recordedAmendment", "silentRevision", "reformatted", "removed")
#: Kinds whose values are written first when a bundle can't hold all of them.
DETAIL_ORDER = ("silentRevision", "removed", "reformatted", "recordedAmendment", "added")
#: Table whose new rows amend a contract that was there before.
CONTRACT_TABLE = "Contratos"


@dataclass(frozen=True)
class Stage:
    """A duration between two columns of stage_dates."""

    key: str
    start: str
    end: str


# The stages of a procedure.
STAGES = (
    Stage("publication_to_award", "publicacion", "adjudicacion_firme"),
    Stage("award_to_contract", "adjudicacion_firme", "fecha_elaboracion_contrato"),
    Stage("award_to_payment", "adjudicacion_firme", "fecha_resul_pago"),
    Stage("award_to_first_payment_request", "adjudicacion_firme", "fecha_1ra_sol_pago"),
    Stage("contract_to_payment", "fecha_elaboracion_contrato", "fecha_resul_pago"),
)


@dataclass(frozen=True)
class TableDef:
    """Key and volatile columns of a published table."""

    key: tuple[str, ...] = ()
    volatile: tuple[str, ...] = ()


@dataclass(frozen=True)
class Source:
    """A publisher: its archive periods and when they close."""

    id: str
    country: str
    granularity: str
    first_period: str
    grace_days: int
    tables: dict[str, TableDef] = field(default_factory=dict)


#: Version of the canonical rules; pass another one to reproduce digests made under it.
CANON_VERSION = "cartulary-canon-2"
BUNDLE_VERSION = "cartulary-bundle-2"
FIELD_MARK, RECORD_MARK, PART_MARK = "\x1f", "\x1e", "\x00"


# Published tables of the first publisher, with their keys and volatile columns.
CR_TABLES: dict[str, TableDef] = {
    "AdjudicacionesFirme": TableDef(("NRO_SICOP", "NRO_ACTO"), ("FECHA_REV",)),
    "Contratos": TableDef(("NRO_CONTRATO", "SECUENCIA")),
    "DetalleCarteles": TableDef(("NRO_SICOP",), ("FECHA_MOD",)),
    "DetalleLineaCartel": TableDef(("NRO_SICOP", "NUMERO_LINEA", "NUMERO_PARTIDA")),
    "FechaPorEtapas": TableDef(("NRO_SICOP", "CARTEL_SEQ", "PARTIDA", "LINEA")),
    "FuncionariosInhibicion": TableDef(("CED_INSTITUCION", "CED_FUNCIONARIO", "FECHA_INICIO"), ("fecha_registro",)),
    "Garantias": TableDef(("NRO_SICOP", "nro_garantia", "gara_seq"), ("fecha_registro",)),
    "InstitucionesRegistradas": TableDef(("CEDULA",), ("FECHA_MOD",)),
    "InvitacionProcedimiento": TableDef(("NRO_SICOP", "CEDULA_PROVEEDOR", "SECUENCIA")),
    "LineasAdjudicadas": TableDef(("NRO_SICOP", "NRO_OFERTA", "NRO_LINEA", "NRO_ACTO")),
    "LineasContratadas": TableDef(("NRO_SICOP", "NRO_CONTRATO", "SECUENCIA", "NRO_LINEA_CONTRATO")),
    "LineasOfertadas": TableDef(("NRO_SICOP", "NRO_OFERTA", "NRO_LINEA")),
    "LineasRecibidas": TableDef(("NRO_SICOP", "NRO_CONTRATO", "SECUENCIA", "NRO_LINEA", "ENTREGA", "NRO_RECEP_DEFINITIVA")),
    "Ofertas": TableDef(("NRO_SICOP", "NRO_OFERTA")),
    "OrdenPedido": TableDef(("NRO_SICOP", "NRO_ORDEN", "LINEA_ORD_PEDIDO", "FECHA_ELABORACION_ORDEN"), ("FECHAREGISTRO",)),
    "ProcedimientoADM": TableDef(("NRO_SICOP", "NUMERO_PA", "CEDULA_PROVEEDOR")),
    "ProcedimientoAdjudicacion": TableDef(("NRO_SICOP", "LINEA", "CEDULA_PROVEEDOR"), ("fecha_rev",)),
    "Proveedores": TableDef(("CEDULA_PROVEEDOR",), ("fecha_registro", "fecha_mod")),
    "ReajustePrecios": TableDef(("NRO_SICOP", "NRO_CONTRATO", "NRO_LINEA_CONTRATO", "NUMERO_REAJUSTE")),
    "Recepciones": TableDef(("NRO_SICOP", "NRO_CONTRATO", "NRO_RECEP_DEFINITIVA")),
    "RecursosObjecion": TableDef(("NRO_RECURSO", "LINEA_OBJETADA")),
    "Remates": TableDef(("NRO_SICOP", "CED_PROVEEDOR", "MONTO_PUJA"), ("fecha_mod",)),
    "SancionProveedores": TableDef(("CEDULA_PROVEEDOR", "CEDULA_INSTITUCION", "NO_RESOLUCION", "CODIGO_PRODUCTO"), ("fecha_registro",)),
    "SistemaEvaluacionOfertas": TableDef(("NRO_SICOP", "EVAL_ITEM_SEQNO"), ("fecha_registro",)),
    "Sistemas": TableDef(("NRO_SICOP", "NUMERO_LINEA", "NUMERO_PARTIDA")),
}
#: Its tables whose ids start with the number of the procedure.
PROCEDURE_TABLES = tuple(name for name, d in CR_TABLES.items() if d.key[0] == "NRO_SICOP")

_OCID, _AWARD, _BID, _PARTY = "ocid", "compiledRelease/awards/0/id", "compiledRelease/bids/details/0/id", "compiledRelease/parties/0/id"
# Published tables of the second publisher, with their keys.
PA_TABLES: dict[str, TableDef] = {
    "com_awa_items": TableDef((_OCID, _AWARD, "compiledRelease/awards/0/items/0/id")),
    "com_awa_suppliers": TableDef((_OCID, _AWARD)),
    "com_awards": TableDef((_OCID, _AWARD)),
    "com_bid_det_documents": TableDef((_OCID, _BID, "compiledRelease/bids/details/0/documents/0/id")),
    "com_bid_det_items": TableDef((_OCID, _BID, "compiledRelease/bids/details/0/items/0/id")),
    "com_bid_det_tenderers": TableDef((_OCID, _BID)),
    "com_bid_details": TableDef((_OCID, _BID)),
    "com_con_documents": TableDef((_OCID, "compiledRelease/contracts/0/documents/0/id")),
    "com_par_additionalIdentifiers": TableDef((_OCID, _PARTY)),
    "com_parties": TableDef((_OCID, _PARTY)),
    "com_pla_bud_budgetBreakdown": TableDef((_OCID, "compiledRelease/planning/budget/budgetBreakdown/0/id")),
    "com_relatedProcesses": TableDef((_OCID,)),
    "com_sources": TableDef((_OCID,)),
    "com_ten_items": TableDef((_OCID, "compiledRelease/tender/items/0/id")),
    "com_ten_tenderers": TableDef((_OCID, "compiledRelease/tender/tenderers/0/id")),
    "records": TableDef((_OCID,)),
    "releases": TableDef((_OCID, "releases/0/url")),
}
SOURCES = {
    "cr": Source("cr", "CR", "month", "201012", 2, CR_TABLES),
    "pa": Source("pa", "PA", "month", "202309", 2, PA_TABLES),
}


def source(id_: str) -> Source:
    """A publisher by its id."""
    if id_ not in SOURCES:
        raise ValueError(f"unknown source: {id_}")
    return SOURCES[id_]
