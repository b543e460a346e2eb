"""Table registry: declared column types per archive table, and the key columns the operators default to.

Archive cells are always read as strings and cast from this registry, so a malformed cell becomes a
countable null instead of a dropped line or an inferred type.
"""

from __future__ import annotations

# --- fixed values: archive column names, service codes and category labels -----------------------

N_BANDS = 10
PRICE_BANDS = [f"PRICEBAND{i}" for i in range(1, N_BANDS + 1)]
QUANTITY_BANDS = [f"BANDAVAIL{i}" for i in range(1, N_BANDS + 1)]

SERVICES = sorted([
    "RAISE1SEC", "RAISE6SEC", "RAISE60SEC", "RAISE5MIN", "RAISEREG",
    "LOWER1SEC", "LOWER6SEC", "LOWER60SEC", "LOWER5MIN", "LOWERREG",
])
ENERGY = "ENERGY"

AUTOBIDDER_BATTERY = "Autobidder Battery"
OTHER_BATTERY = "Non-Autobidder Battery"
NON_BATTERY = "Non-Battery"
CATEGORIES = [AUTOBIDDER_BATTERY, OTHER_BATTERY, NON_BATTERY]
BATTERY_CATEGORIES = [AUTOBIDDER_BATTERY, OTHER_BATTERY]

VIRTUAL_PLANTS = ["VSSEL1V1"]

# One auction: a unit, a service, a side of the market and a market day. DIRECTION belongs in it because a
# battery bids a GEN and a LOAD side under the same unit and service.
AUCTION = ["DUID", "BIDTYPE", "DIRECTION", "SETTLEMENTDATE"]
OFFER_TIME = "OFFERDATE"
# What settles offers of one instant, before their bands.
TIEBREAKS = ["VERSIONNO", "REFERENCE_ID"]
PERIOD = "PERIODID"

# Leading columns of every archive line: record type, package, table name, table version.
LINE_PREFIX = ["REC", "PACKAGE", "TABLENAME", "TABLEVERSION"]

# --- declared types (fixed values: names and types of the archive's tables) -------------------------------------------------------------------------------
# "date" = a market day, "timestamp_ntz" = local market time (the market has no daylight saving).

REGIONAL_PRICES = ["RRP", *[f"{s}RRP" for s in SERVICES]]

TABLES: dict[str, list[tuple[str, str]]] = {
    "BIDDAYOFFER": [
        ("DUID", "string"), ("BIDTYPE", "string"), ("SETTLEMENTDATE", "date"), ("OFFERDATE", "timestamp_ntz"),
        ("DIRECTION", "string"), ("VERSIONNO", "int"), ("PARTICIPANTID", "string"),
        ("DAILYENERGYCONSTRAINT", "double"), ("REBIDEXPLANATION", "string"),
        *[(b, "double") for b in PRICE_BANDS],
        ("MINIMUMLOAD", "double"), ("T1", "double"), ("T2", "double"), ("T3", "double"), ("T4", "double"),
        ("NORMALSTATUS", "string"), ("LASTCHANGED", "timestamp_ntz"), ("MR_FACTOR", "double"),
        ("ENTRYTYPE", "upper"), ("REBID_EVENT_TIME", "string"), ("REBID_AWARE_TIME", "string"),
        ("REBID_DECISION_TIME", "string"), ("REBID_CATEGORY", "string"), ("REFERENCE_ID", "string"),
    ],
    "BIDOFFERPERIOD": [
        ("DUID", "string"), ("BIDTYPE", "string"), ("TRADINGDATE", "date"), ("OFFERDATETIME", "timestamp_ntz"),
        ("DIRECTION", "string"), ("PERIODID", "int"), ("MAXAVAIL", "double"), ("FIXEDLOAD", "double"),
        ("RAMPUPRATE", "double"), ("RAMPDOWNRATE", "double"), ("ENABLEMENTMIN", "double"),
        ("ENABLEMENTMAX", "double"), ("LOWBREAKPOINT", "double"), ("HIGHBREAKPOINT", "double"),
        *[(b, "double") for b in QUANTITY_BANDS],
        ("PASAAVAILABILITY", "double"), ("ENERGYLIMIT", "double"), ("PERIODIDTO", "int"),
        ("RECALL_PERIOD", "double"),
    ],
    # Tables known by some of their columns only; the reader finds those by name.
    "DISPATCHOFFERTRK": [
        ("SETTLEMENTDATE", "timestamp_ntz"), ("DUID", "string"), ("BIDTYPE", "string"),
        ("BIDSETTLEMENTDATE", "date"), ("BIDOFFERDATE", "timestamp_ntz"),
    ],
    "DISPATCHPRICE": [
        ("SETTLEMENTDATE", "timestamp_ntz"), ("RUNNO", "int"), ("REGIONID", "string"), ("INTERVENTION", "int"),
        *[(p, "double") for p in REGIONAL_PRICES],
    ],
    "DISPATCHLOAD": [
        ("SETTLEMENTDATE", "timestamp_ntz"), ("RUNNO", "int"), ("DUID", "string"), ("INTERVENTION", "int"),
        ("INITIALMW", "double"), ("TOTALCLEARED", "double"), *[(s, "double") for s in SERVICES],
    ],
    "DISPATCHREGIONSUM": [
        ("SETTLEMENTDATE", "timestamp_ntz"), ("RUNNO", "int"), ("REGIONID", "string"), ("INTERVENTION", "int"),
        ("TOTALDEMAND", "double"), ("AVAILABLEGENERATION", "double"), ("DEMANDFORECAST", "double"),
    ],
    "DISPATCHCONSTRAINT": [
        ("SETTLEMENTDATE", "timestamp_ntz"), ("RUNNO", "int"), ("CONSTRAINTID", "string"), ("INTERVENTION", "int"),
        ("RHS", "double"), ("MARGINALVALUE", "double"), ("VIOLATIONDEGREE", "double"), ("LHS", "double"),
    ],
    "DUDETAILSUMMARY": [
        ("DUID", "string"), ("START_DATE", "timestamp_ntz"), ("END_DATE", "timestamp_ntz"),
        ("DISPATCHTYPE", "upper"), ("REGIONID", "string"), ("STATIONID", "string"), ("PARTICIPANTID", "string"),
    ],
    "DUDETAIL": [
        ("EFFECTIVEDATE", "timestamp_ntz"), ("DUID", "string"), ("VERSIONNO", "int"), ("REGISTEREDCAPACITY", "double"),
        ("MAXCAPACITY", "double"), ("DISPATCHTYPE", "upper"), ("CONNECTIONPOINTID", "string"), ("MAXSTORAGECAPACITY", "double"),
    ],
    "DEMANDOPERATIONALACTUAL": [
        ("INTERVAL_DATETIME", "timestamp_ntz"), ("REGIONID", "string"), ("OPERATIONAL_DEMAND", "double"),
    ],
    "DEMANDOPERATIONALFORECAST": [
        ("INTERVAL_DATETIME", "timestamp_ntz"), ("REGIONID", "string"), ("LOAD_DATE", "timestamp_ntz"),
        ("OPERATIONAL_DEMAND_POE10", "double"), ("OPERATIONAL_DEMAND_POE50", "double"), ("OPERATIONAL_DEMAND_POE90", "double"),
    ],
    "PREDISPATCHREGIONSUM": [
        ("PREDISPATCHSEQNO", "string"), ("RUNNO", "int"), ("REGIONID", "string"), ("INTERVENTION", "int"),
        ("DATETIME", "timestamp_ntz"), ("LASTCHANGED", "timestamp_ntz"), ("TOTALDEMAND", "double"),
    ],
    "P5MIN_REGIONSOLUTION": [
        ("RUN_DATETIME", "timestamp_ntz"), ("INTERVAL_DATETIME", "timestamp_ntz"), ("REGIONID", "string"), ("TOTALDEMAND", "double"),
    ],
    "TRADINGPRICE": [
        ("SETTLEMENTDATE", "timestamp_ntz"), ("RUNNO", "int"), ("REGIONID", "string"), ("PERIODID", "int"),
        *[(p, "double") for p in REGIONAL_PRICES], ("PRICE_STATUS", "upper"),
    ],
    "DISPATCHINTERCONNECTORRES": [
        ("SETTLEMENTDATE", "timestamp_ntz"), ("RUNNO", "int"), ("INTERCONNECTORID", "string"), ("INTERVENTION", "int"),
        ("METEREDMWFLOW", "double"), ("MWFLOW", "double"), ("MWLOSSES", "double"), ("MARGINALVALUE", "double"),
        ("EXPORTLIMIT", "double"), ("IMPORTLIMIT", "double"),
    ],
    "GENCONDATA": [
        ("EFFECTIVEDATE", "timestamp_ntz"), ("VERSIONNO", "int"), ("GENCONID", "string"), ("CONSTRAINTTYPE", "string"),
        ("CONSTRAINTVALUE", "double"), ("DESCRIPTION", "string"), ("SOURCE", "string"), ("LIMITTYPE", "string"), ("REASON", "string"),
    ],
    "GENCONSET": [
        ("GENCONSETID", "string"), ("EFFECTIVEDATE", "timestamp_ntz"), ("VERSIONNO", "int"), ("GENCONID", "string"),
    ],
    "GENCONSETINVOKE": [
        ("GENCONSETID", "string"), ("STARTINTERVALDATETIME", "timestamp_ntz"), ("ENDINTERVALDATETIME", "timestamp_ntz"),
    ],
    "SPDCONNECTIONPOINTCONSTRAINT": [
        ("CONNECTIONPOINTID", "string"), ("EFFECTIVEDATE", "timestamp_ntz"), ("VERSIONNO", "int"), ("GENCONID", "string"),
        ("FACTOR", "double"), ("BIDTYPE", "string"),
    ],
}

# Detail-table names aligned to the header table.
ALIGN_DETAIL = {"TRADINGDATE": "SETTLEMENTDATE", "OFFERDATETIME": "OFFERDATE"}
