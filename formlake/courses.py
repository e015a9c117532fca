"""The course allowlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The 90 course names kept by the ingest.
UK_COURSES = [
    "Aintree", "Ascot", "Ayr", "Bangor-on-Dee", "Bath", "Beverley", "Brighton", "Carlisle",
    "Cartmel", "Catterick", "Chelmsford (AW)", "Cheltenham", "Chepstow", "Chester", "Doncaster",
    "Epsom", "Exeter", "Ffos Las", "Fontwell", "Goodwood", "Hamilton", "Haydock", "Hexham",
    "Huntingdon", "Kelso", "Kempton", "Kempton (AW)", "Leicester", "Lingfield", "Lingfield (AW)",
    "Ludlow", "Market Rasen", "Musselburgh", "Newbury", "Newcastle", "Newmarket",
    "Newmarket (July)", "Newmarket (Rowley)", "Newton Abbot", "Nottingham", "Perth", "Plumpton",
    "Pontefract", "Redcar", "Ripon", "Salisbury", "Sandown", "Sedgefield", "Southwell",
    "Southwell (AW)", "Stratford", "Taunton", "Thirsk", "Towcester", "Uttoxeter", "Warwick",
    "Wetherby", "Wincanton", "Windsor", "Wolverhampton (AW)", "Worcester", "Yarmouth", "York",
]
IRISH_COURSES = [
    "Ballinrobe (IRE)", "Bellewstown (IRE)", "Clonmel (IRE)", "Cork (IRE)", "Curragh (IRE)",
    "Down Royal (IRE)", "Downpatrick (IRE)", "Dundalk (AW) (IRE)", "Fairyhouse (IRE)",
    "Galway (IRE)", "Gowran (IRE)", "Gowran Park (IRE)", "Kilbeggan (IRE)", "Killarney (IRE)",
    "Laytown (IRE)", "Leopardstown (IRE)", "Limerick (IRE)", "Listowel (IRE)", "Naas (IRE)",
    "Navan (IRE)", "Punchestown (IRE)", "Roscommon (IRE)", "Sligo (IRE)", "Thurles (IRE)",
    "Tipperary (IRE)", "Tramore (IRE)", "Wexford (IRE)",
]
ALLOWED_COURSES = UK_COURSES + IRISH_COURSES


def allowed_courses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name,) for name in ALLOWED_COURSES], "course string")
