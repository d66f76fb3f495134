"""Hand-made register rows for unit tests."""

from tenderlake.sources.schemas import CONTRACT, GROUPS_SEED


def contract(i, montant=1000.0, date="2020-03-01", cpv="72000000", buyer="B1", holder="H1",
             proc="Procédure adaptée", place=None, mods=None, objet=None, duree=12.0, holders=None):
    if holders is None:
        holders = None if holder is None else [{"titulaire": {"id": holder}}]
    return {
        "id": str(i), "montant": montant, "dureeMois": duree, "objet": objet or f"objet {i}",
        "codeCPV": cpv, "procedure": proc, "dateNotification": date,
        "acheteur": None if buyer is None else {"id": buyer},
        "titulaires": holders,
        "lieuExecution": place, "modifications": mods,
    }


def raw_df(spark, rows):
    return spark.createDataFrame(rows, CONTRACT)


def groups_df(spark, rows):
    return spark.createDataFrame(rows, GROUPS_SEED)
