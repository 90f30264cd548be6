"""Injection patterns, restricted-substance screening and the policy lattice.

Substances are held as names, registry numbers and categories only, which is what screening needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orefield.functions import chemistry as C
from orefield.functions import text as T

# The pattern groups.
INJECTION = (
    r"ignore\s+(?:all\s+)?(?:previous|prior)\s+(?:instructions|rules|prompts|constraints)",
    r"disregard\s+(?:all\s+)?(?:safety|system|compliance)\s+(?:rules|policies|guidelines)",
    r"you\s+are\s+now\s+(?:unrestricted|in\s+developer\s+mode|dan\s+mode|jailbroken)",
    r"bypass\s+(?:all\s+)?(?:safety|policy|security|guardrails|checks)",
    r"system\s*:\s*you\s+must\s+comply",
    r"override\s+(?:policy|filter|safety\s+guard)",
    r"pretend\s+(?:there\s+are\s+no\s+rules|you\s+have\s+no\s+ethics)",
    r"disable\s+(?:safety|content\s+filter|guardrails)",
)
SPOOF = (
    r"user_role\s*[:=]\s*['\"]?admin['\"]?",
    r"safety_decision\s*[:=]\s*['\"]?ALLOW['\"]?",
    r"override_role\s*[:=]",
    r"authorization\s*[:=]\s*['\"]?super_user['\"]?",
)
TOOL = (
    r"\b(?:exec|eval|__import__|subprocess|os\.system|shutil)\b",
    r"\b(?:bash|powershell|cmd\.exe|/bin/sh)\b",
    r"\b(?:cat\s+/etc/passwd|type\s+c:\\windows)\b",
    r"invoke_tool\s*\(",
    r"call_tool\s*\(",
    r"DROP\s+TABLE|SELECT\s+\*\s+FROM\s+users|--\s*$",
)
ENCODED = r"([A-Za-z0-9+/]{20,}={0,2})"

# Id, name, registry number, category, further names.
REGISTRY = (
    ("CWC-1-001", "Sarin", "107-44-8", "cwc_schedule_1", ("GB", "isopropyl methylphosphonofluoridate", "sarin nerve agent", "zarin")),
    ("CWC-1-002", "Soman", "96-64-0", "cwc_schedule_1", ("GD", "pinacolyl methylphosphonofluoridate", "soman nerve agent")),
    ("CWC-1-003", "Tabun", "77-81-6", "cwc_schedule_1", ("GA", "ethyl dimethylphosphoramidocyanidate", "tabun nerve agent")),
    ("CWC-1-004", "VX", "50782-69-9", "cwc_schedule_1", ("O-ethyl S-[2-(diisopropylamino)ethyl] methylphosphonothioate", "vx nerve agent", "vx gas")),
    ("CWC-1-005", "Sulfur Mustard", "505-60-2", "cwc_schedule_1", ("mustard gas", "bis(2-chloroethyl) sulfide", "yperite", "hd agent", "mustard agent")),
    ("CWC-1-006", "Novichok A-234", "26002-80-2", "cwc_schedule_1", ("novichok", "a-234", "fourth-generation nerve agent", "a-230", "a-232")),
    ("CWC-1-007", "Ricin", "9009-86-3", "lethal_toxin", ("ricin toxin", "ricinus communis lectin", "ricin protein")),
    ("CWC-2-001", "Amiton", "78-53-5", "cwc_schedule_2", ("VG", "O,O-diethyl S-[2-(diethylamino)ethyl] phosphorothioate")),
    ("CWC-3-001", "Phosgene", "75-44-5", "cwc_schedule_3", ("carbonyl dichloride", "carbon oxychloride", "phosgene gas")),
    ("EXP-001", "TATP", "17088-37-8", "explosive_precursor", ("triacetone triperoxide", "peroxyacetone", "acetone peroxide", "tatp explosive")),
    ("EXP-002", "RDX", "121-82-4", "explosive_precursor", ("cyclonite", "hexogen", "t4", "research department explosive", "rdx explosive")),
    ("DRUG-001", "ANPP", "21409-26-7", "illicit_drug_precursor", ("4-anilino-N-phenethylpiperidine", "fentanyl precursor ANPP", "norfentanyl intermediate")),
)
SYNTHESIS_ACTIONS = ("synthesis", "reaction_synthesis", "preparation", "manufacturing", "chemistry_synthesis", "chemistry_reasoning_and_validation")
AUTONOMOUS_ACTIONS = ("autonomous_execution", "robotic_synthesis", "lab_execution")
SYNTHESIS_TEXT = ("how to make", "synthesize", "synthesis route", "provide synthesis", "procedure", "step by step", "make ", "produce ", "manufacture", "preparation of", "clandestine", "precursor")
DECISIONS = ("ALLOW", "ALLOW_WITH_WARNING", "REQUIRE_REVIEW", "REFUSE")
STATUS = {"ALLOW": "allowed", "ALLOW_WITH_WARNING": "flagged", "REQUIRE_REVIEW": "flagged", "REFUSE": "blocked"}


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))


def injected(text: Column) -> Column:
    """Direct patterns, the same within decoded base64 runs, or spoofed policy fields."""
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(ENCODED), F.lit(1))
    decoded = F.exists(runs, lambda r: F.coalesce(_any(F.try_to_binary(F.substr(r, F.lit(1), (F.length(r) / 4).cast("int") * 4), F.lit("base64")).cast("string"), INJECTION), F.lit(False)))
    return _any(text, INJECTION) | decoded | _any(text, SPOOF)


def tool_injected(text: Column) -> Column:
    return _any(F.coalesce(text, F.lit("")), TOOL)


def document_injected(text: Column) -> Column:
    return injected(text) | tool_injected(text)


def registry(spark: SparkSession) -> DataFrame:
    """(chemical_id, name, cas, category): twelve rows, and that bounds every join with it."""
    rows = [x[:4] for x in REGISTRY]
    return spark.createDataFrame(rows, "chemical_id string, name string, cas string, category string")


def screen_text(df: DataFrame, text: str = "text") -> DataFrame:
    """df plus (chemical_id, name, category, matched_by, confidence), a row for each substance that a text mentions.

    A valid registry number comes before a whole-word name, and that before a name of four or more letters within the
    text without look-alikes and separators. Each text meets the twelve registry rows, which are broadcast.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    numbers = F.filter(F.regexp_extract_all(t, F.lit(C.ANY_CAS), F.lit(1)), C.cas_valid)
    pairs = df.withColumns({"_numbers": numbers, "_bare": T.deobfuscate(t)}).crossJoin(F.broadcast(registry(df.sparkSession)))
    by_number = F.array_contains(F.col("_numbers"), F.col("cas"))
    cases = (F.when(F.col("chemical_id") == i, t.rlike("(?i)" + "|".join(rf"\b{_literal(n)}\b" for n in (name, *more)))) for i, name, _, _, more in REGISTRY)
    by_name = F.coalesce(*cases)
    bare_name = T.deobfuscate(F.col("name"))
    by_bare = (F.length(bare_name) >= 4) & F.contains(F.col("_bare"), bare_name)
    how = F.when(by_number, "cas_number").when(by_name, "text_mention").when(by_bare, "deobfuscated_mention")
    confidence = F.when(F.col("matched_by") == "cas_number", 1.0).when(F.col("matched_by") == "text_mention", 0.95).otherwise(0.90)
    return pairs.withColumn("matched_by", how).where("matched_by is not null").withColumn("confidence", confidence).drop("_numbers", "_bare", "cas")


def _literal(name: str) -> str:
    return "".join("\\" + c if c in "[]().,-" else c for c in name)


def screen_identifier(identifier: Column) -> Column:
    """The id of the first registry row whose number, or a name of four or more letters, the identifier is or holds."""
    c = F.trim(identifier)
    bare = T.deobfuscate(c)
    number = F.regexp_replace(c, r"[^0-9\-]", "")
    tests = []
    for i, name, cas, _, more in REGISTRY:
        names = [T.deobfuscate(F.lit(n)) for n in (name, *more)]
        holds = F.lit(False)
        for n in names:
            holds = holds | ((F.length(n) >= 4) & (F.length(bare) >= 4) & (F.contains(bare, n) | F.contains(n, bare))) | (bare == n)
        tests.append(F.when((C.cas_valid(number) & (number == cas)) | holds, F.lit(i)))
    return F.coalesce(*tests)


def decide(requests: DataFrame) -> DataFrame:
    """requests (request_id, query, action, role, intent, context) -> (request_id, decision, rules, n_matches).

    Injected queries, tools and contexts and autonomous actions are refused; then each substance found in query or
    context is judged by its category, and the most severe judgement stands.
    """
    q, lower = F.coalesce("query", F.lit("")), F.lower(F.coalesce("query", F.lit("")))
    context = F.coalesce("context", F.lit(""))
    texts = requests.withColumn("_both", F.concat_ws("\n", q, context))
    refused = injected(q) | tool_injected(q) | ((context != "") & document_injected(context))
    base = texts.withColumns(
        {
            "_refused": F.when(refused, "RULE-001-INJECTION").when(F.col("action").isin(*AUTONOMOUS_ACTIONS), "RULE-002-AUTONOMOUS"),
            "_action": F.col("action").isin(*SYNTHESIS_ACTIONS) | (F.coalesce("intent", F.lit("")) == "reaction_synthesis"),
            "_text": F.greatest(*(F.contains(lower, F.lit(p)) for p in SYNTHESIS_TEXT)),
        }
    )
    found = screen_text(base, "_both")
    k, synth = F.col("category"), F.col("_action") | F.col("_text")
    lethal = k.isin("cwc_schedule_1", "lethal_toxin")
    severity = (
        F.when(lethal, F.when(synth | F.contains(lower, F.lit("nerve agent")) | F.contains(lower, F.lit("chemical weapon")), 3).otherwise(1))
        .when(k == "explosive_precursor", F.when(synth | F.contains(lower, F.lit("make")), 3).otherwise(1))
        .when(k == "illicit_drug_precursor", F.when(F.col("_action"), 3).otherwise(1))
        .otherwise(F.when(~F.col("_action"), 1).when(F.col("role").isin("guest", "student"), 3).otherwise(2))
    )
    rule = (
        F.when(lethal, "RULE-003-CWC1")
        .when(k == "explosive_precursor", "RULE-004-EXPLOSIVES")
        .when(k == "illicit_drug_precursor", "RULE-005-DRUG-PRECURSORS")
        .otherwise(F.when(F.col("_action"), "RULE-007-RESEARCHER-REVIEW").otherwise("RULE-006-DUAL-USE-LOOKUP"))
    )
    judged = found.select("request_id", severity.alias("severity"), rule.alias("rule"))
    worst = judged.groupBy("request_id").agg(F.max("severity").alias("severity"), F.sort_array(F.collect_set("rule")).alias("rules"), F.count("*").alias("n"))
    out = base.join(worst, "request_id", "left")
    level = F.when(F.col("_refused").isNotNull(), 3).otherwise(F.coalesce("severity", F.lit(0)))
    return out.select(
        "request_id",
        F.element_at(F.array(*map(F.lit, DECISIONS)), level + 1).alias("decision"),
        F.when(F.col("_refused").isNotNull(), F.array("_refused")).otherwise(F.coalesce("rules", F.array().cast("array<string>"))).alias("rules"),
        F.when(F.col("_refused").isNotNull(), 0).otherwise(F.coalesce("n", F.lit(0))).alias("n_matches"),
    )


def event_status(decision: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv)), decision)


def gate(decisions: DataFrame) -> DataFrame:
    """Adds executed and warnings: refusals and reviews stop a tool, warnings go along with its result."""
    run = F.col("decision").isin("ALLOW", "ALLOW_WITH_WARNING")
    return decisions.withColumns({"executed": run, "warnings": F.when(F.col("decision") == "ALLOW_WITH_WARNING", F.col("rules")).otherwise(F.array().cast("array<string>"))})


def tool_text(args: Column, fields: list[str], entity_fields: list[str]) -> Column:
    """struct<text, entities>: all strings of a tool's arguments in one text, and those of the named fields as a list."""
    texts = [args[f] if not f.endswith("[]") else F.array_join(args[f[:-2]], " ") for f in fields]
    return F.struct(F.concat_ws(" ", *texts).alias("text"), F.array_compact(F.array(*(args[f] for f in entity_fields))).alias("entities"))


def recent(df: DataFrame, order: str, n: int, by: str | None = None) -> DataFrame:
    """The newest n rows, of each key if one is named."""
    if by is None:
        return df.orderBy(F.desc(order)).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")
