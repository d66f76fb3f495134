"""Company name -> economic group, by an ordered keyword table.

The first keyword found (as a substring of the upper-cased name) wins; no
match gives 'INDEPENDANT'. The mapping is a chain of ``when`` expressions
generated from the table, so it runs JVM-side with no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_GROUP = "INDEPENDANT"

# First keyword list (reference rebuild), in its order.
# 'EY ' keeps its trailing blank on purpose.
KEYWORDS_REFERENCE = [
    ("CAPGEMINI", "CAPGEMINI"), ("SOGETI", "CAPGEMINI"), ("ALTRAN", "CAPGEMINI"),
    ("SOPRA", "SOPRA STERIA"), ("STERIA", "SOPRA STERIA"),
    ("ACCENTURE", "ACCENTURE"),
    ("IBM", "IBM"),
    ("ORANGE", "ORANGE"),
    ("ATOS", "ATOS"), ("BULL", "ATOS"), ("WORLDLINE", "ATOS"),
    ("CGI", "CGI"),
    ("UMANIS", "UMANIS"),
    ("ERNST", "EY"), ("EY ", "EY"),
    ("DELOITTE", "DELOITTE"),
    ("KPMG", "KPMG"),
    ("WAVESTONE", "WAVESTONE"),
    ("BEARINGPOINT", "BEARINGPOINT"),
    ("DEVOTEAM", "DEVOTEAM"),
    ("ECONOCOM", "ECONOCOM"),
]

# Second keyword list (unmapped-company enrichment), in its
# order. 'EY ' and 'OPEN ' keep their trailing blank; ECONOCOM appears twice.
KEYWORDS_ENRICHMENT = [
    ("CAPGEMINI", "CAPGEMINI"), ("SOGETI", "CAPGEMINI"), ("ALTRAN", "CAPGEMINI"),
    ("SOPRA", "SOPRA STERIA"), ("STERIA", "SOPRA STERIA"), ("ACCENTURE", "ACCENTURE"),
    ("IBM", "IBM"), ("ORANGE", "ORANGE"), ("ATOS", "ATOS"), ("BULL", "ATOS"),
    ("CGI", "CGI"), ("INETUM", "INETUM"), ("SFR", "SFR"), ("BOUYGUES", "BOUYGUES"),
    ("THALES", "THALES"), ("AIRBUS", "AIRBUS"), ("DASSAULT", "DASSAULT"),
    ("EY ", "EY"), ("ERNST", "EY"), ("DELOITTE", "DELOITTE"), ("KPMG", "KPMG"),
    ("WAVESTONE", "WAVESTONE"), ("DEVOTEAM", "DEVOTEAM"), ("ECONOCOM", "ECONOCOM"),
    ("COMPUTACENTER", "COMPUTACENTER"), ("MC2I", "MC2I"), ("DOCAPOSTE", "DOCAPOSTE"),
    ("INTRINSEC", "INTRINSEC"), ("STELOGY", "STELOGY"), ("MALT", "MALT"),
    ("RICOH", "RICOH"), ("CHEOPS", "CHEOPS"), ("ADVENS", "ADVENS"), ("LINKT", "LINKT"),
    ("OPEN ", "OPEN"), ("HEXAGONE", "HEXAGONE DIGITALE"), ("CRAYON", "CRAYON"),
    ("AXIANS", "AXIANS"), ("ECONOCOM", "ECONOCOM"), ("MAGELLAN", "MAGELLAN"),
    ("AUBAY", "AUBAY"), ("MICROPOLE", "MICROPOLE"), ("NEXEO", "NEXEO"),
]

def map_group(name: Column | str, keywords=KEYWORDS_REFERENCE,
              default: str = DEFAULT_GROUP) -> Column:
    """Group of a company name; first matching keyword in table order."""
    upper = F.upper(F.col(name) if isinstance(name, str) else name)
    out = None
    for kw, group in keywords:
        cond = upper.contains(F.lit(kw))
        out = F.when(cond, F.lit(group)) if out is None else out.when(cond, F.lit(group))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))

