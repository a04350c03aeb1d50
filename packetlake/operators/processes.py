"""Verdicts on processes from facts about them: signature, place, age, known hash, detections, and what started them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Publishers that count as trusted where their name holds one of these, places, and names of parents.
TRUSTED = (
    "microsoft corporation", "microsoft windows", "google llc", "google inc", "apple inc", "mozilla corporation", "adobe inc", "adobe systems incorporated", "valve corp", "valve", "discord inc",
    "slack technologies", "zoom video communications", "spotify ab", "intel corporation", "intel(r) corporation", "nvidia corporation", "advanced micro devices", "amd", "logitech", "logitech inc",
    "realtek semiconductor", "eset, spol. s r.o.", "eset", "malwarebytes inc", "norton lifelock", "symantec corporation", "crowdstrike inc", "dell inc", "dell technologies", "hp inc", "hewlett-packard",
    "lenovo", "oracle corporation", "dropbox inc", "github inc", "brave software inc", "opera software", "epic games inc", "riot games", "electronic arts", "ubisoft", "blizzard entertainment", "cloudflare inc",
)
SYSTEM_PLACES = ("c:\\windows",)
PROGRAM_PLACES = ("c:\\program files",)
ODD_PLACES = ("temp", "tmp", "appdata\\local\\temp", "downloads", "recycle.bin", "$recycle.bin", "programdata", "public", "users\\public")
SHELLS, OWNED, SCRIPT_HOSTS = ("cmd.exe", "powershell.exe", "pwsh.exe"), ("svchost.exe", "lsass.exe", "csrss.exe"), ("wscript.exe", "cscript.exe", "mshta.exe")
LEVELS = 10


def _any(texts):
    test = texts[0]
    for t in texts[1:]:
        test = test | t
    return test


def started_by_scripts(facts: DataFrame, levels: int = LEVELS) -> DataFrame:
    """host, pid of the processes that have a script host among their nearest `levels` ancestors.

    The script hosts go down to their children, and so on; nothing else is followed, and a circle of parents ends with the levels.
    """
    children = facts.select("host", F.col("parent").alias("pid"), F.col("pid").alias("child"))
    level = facts.where(F.lower("name").isin(*SCRIPT_HOSTS)).select("host", "pid").distinct()
    found = None
    for _ in range(levels):
        level = level.join(children, ["host", "pid"]).select("host", F.col("child").alias("pid")).distinct()
        found = level if found is None else found.unionByName(level)
    return found.distinct()


def verdicts(facts: DataFrame, known: DataFrame) -> DataFrame:
    """host, pid, score, verdict, confidence of each process.

    facts: host, pid, parent, name, path, present (the file is there), publisher (null: unsigned), age_days, sha256,
    detections (null: not looked up). known: sha256 of files known to be good. A process without a path is UNKNOWN, one
    whose file is gone SUSPICIOUS, both with no confidence and no score.
    """
    path, publisher = F.lower("path"), F.lower("publisher")
    system, program = (_any([path.startswith(x) for x in places]) for places in (SYSTEM_PLACES, PROGRAM_PLACES))
    odd = _any([path.contains(x) for x in ODD_PLACES])
    signed = F.when(publisher.isNull(), -1).when(_any([publisher.contains(x) for x in TRUSTED]), 3).otherwise(1)
    place = F.when(system, 2).when(program, 1).when(odd, -2).otherwise(0)
    fresh = F.when(system & (F.col("age_days") < 1), -2).otherwise(0)
    seen = F.when(F.col("detections").isNull(), 0).when(F.col("detections") == 0, 2).when(F.col("detections") <= 2, -1).when(F.col("detections") <= 5, -3).otherwise(-5)
    shells = facts.where(F.lower("name").isin(*SHELLS)).select("host", F.col("pid").alias("parent"), F.lit(True).alias("_shell")).distinct()
    scripts = started_by_scripts(facts).withColumn("_script", F.lit(True))
    rows = facts.join(known.select("sha256").distinct().withColumn("_known", F.lit(True)), "sha256", "left").join(shells, ["host", "parent"], "left").join(scripts, ["host", "pid"], "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    parent = F.when((yes(F.col("_shell")) & F.lower("name").isin(*OWNED)) | yes(F.col("_script")), -2).otherwise(0)
    there = F.col("path").isNotNull() & yes(F.col("present"))
    score = F.when(there, signed + place + fresh + F.when(yes(F.col("_known")), 3).otherwise(0) + seen + parent)
    s = F.col("score")
    band = F.when(s >= 4, "VERIFIED_SAFE").when(s >= 2, "LIKELY_SAFE").when(s >= -1, "UNKNOWN").when(s >= -3, "SUSPICIOUS").otherwise("MALICIOUS")
    verdict = F.when(F.col("path").isNull(), "UNKNOWN").when(~there, "SUSPICIOUS").otherwise(band)
    rows = rows.withColumn("score", score.cast("int"))
    return rows.select("host", "pid", "score", verdict.alias("verdict"), F.when(there, F.least(F.abs(s) / 5, F.lit(1.0))).otherwise(0.0).alias("confidence"))
