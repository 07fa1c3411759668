"""Vocabulary packs: a long table of phrases, from nested JSON or from the small pack below."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import UNSEEN

SCHEMA = "lang string, category string, subcategory string, phrase string, attr string, ord int"

# A small pack of our own, (language, category, subcategory, attribute, phrases).
PACK = [
    ("en", "greetings", "", None, ["good morning", "good afternoon", "good evening", "hello", "welcome"]),
    ("hi", "greetings", "", None, ["namaste", "namaskar"]),
    ("en", "trivial", "", None, ["okay", "ok", "yes", "no", "haan ji", "sure", "right", "hello", "good morning", "thank you"]),
    ("hi", "trivial", "", None, ["haan ji", "theek hai", "ji"]),
    ("en", "required", "collections/caller_identification", "fair_practice_code", ["calling from", "my name is", "this is"]),
    ("en", "required", "collections/purpose_disclosure", "fair_practice_code", ["regarding your", "about your", "concerning"]),
    ("en", "required", "collections/recording_consent", "it_act", ["may be recorded", "is being recorded", "recorded for"]),
    ("en", "required", "kyc/identity_verification", "kyc_direction", ["verify", "date of birth", "aadhaar", "pan"]),
    ("en", "required", "kyc/data_consent", "data_protection_act", ["consent", "permission", "authorize"]),
    ("en", "required", "complaint/caller_identification", "fair_practice_code", ["calling from", "my name is"]),
    ("en", "required", "complaint/resolution_timeline", "service_guidelines", ["working days", "get back to you", "two more weeks"]),
    ("en", "required", "onboarding/caller_identification", "fair_practice_code", ["calling from", "my name is", "welcome to"]),
    ("en", "required", "onboarding/product_disclosure", "fair_practice_code", ["interest rate", "processing fee", "tenure", "emi"]),
    ("en", "prohibited", "threats", None, ["arrest warrant", "send our people to your house", "we will seize your"]),
    ("en", "prohibited", "coercion", None, ["your last chance", "you have no choice"]),
    ("en", "prohibited", "misleading", None, ["your score will become zero"]),
    ("en", "prohibited", "harassment", None, ["you should be ashamed", "you are a cheat"]),
    ("en", "prohibited", "privacy_violation", None, ["tell your employer", "your neighbor told"]),
    ("en", "third_party", "", None, ["spoke to your wife", "tell your employer", "informed your family"]),
    ("en", "end_call", "", None, ["stop calling me", "do not call", "leave me alone"]),
    ("en", "fraud", "remote_access", None, ["remote desktop", "share your screen", "screen sharing"]),
    ("en", "fraud", "urgency", None, ["immediately", "right now", "act fast", "last chance"]),
    ("en", "fraud", "credentials", None, ["otp", "cvv", "card number", "pin number"]),
    ("en", "fraud", "authority", None, ["tax department", "police", "from the court"]),
    ("en", "fraud", "vague_identity", None, ["from the lender", "from your bank"]),
    ("en", "fraud", "threats", None, ["arrest warrant", "freeze your account"]),
    ("en", "fraud", "social_engineering", None, ["share your screen", "confirm your account", "remote desktop", "tell your employer"]),
    ("en", "call_type", "collections", None, ["overdue", "outstanding", "emi", "loan"]),
    ("en", "call_type", "kyc", None, ["aadhaar", "pan is", "verification"]),
    ("en", "call_type", "complaint", None, ["complain", "unacceptable", "harassment"]),
    ("en", "call_type", "consent", None, ["consent", "agree", "withdraw"]),
    ("en", "call_type", "onboarding", None, ["welcome", "statement", "tenure"]),
    ("en", "disclaimer", "forward_looking", None, ["forward-looking"]),
    ("en", "disclaimer", "recording", None, ["may be recorded", "is being recorded"]),
    ("en", "disclaimer", "introduction", None, ["my name is", "this is"]),
    ("en", "data_request", "", None, ["date of birth", "account number", "card number", "aadhaar", "pan"]),
    ("en", "data_purpose", "", None, ["to verify", "for verification", "for the purpose"]),
    ("en", "data_consent", "", None, ["do you consent", "i agree", "i consent"]),
    ("en", "data_rights", "", None, ["withdraw your consent", "right to erase"]),
    ("en", "sensitive_id", "", None, ["aadhaar", "pan is", "cvv"]),
    ("hi", "required", "collections/recording_consent", "it_act", ["कॉल रिकॉर्ड हो रही है"]),
    ("hi", "prohibited", "threats", None, ["घर पर आदमी भेजेंगे"]),
    ("ta", "prohibited", "threats", None, ["வீட்டுக்கு ஆள் அனுப்புவோம்"]),
    ("hi", "third_party", "", None, ["आपके account की बात बताई"]),
    ("hi", "end_call", "", None, ["फोन मत करो"]),
    ("hi", "fraud", "credentials", None, ["ओटीपी बताइए"]),
    ("ta", "fraud", "urgency", None, ["உடனே", "இப்போதே"]),
    ("hi", "fraud", "threats", None, ["₹ 500 दे दो"]),
    ("hi", "call_type", "collections", None, ["\u0958र्\u095b बाकी", "किस्त"]),
    ("ta", "data_request", "", None, ["பிறந்த தேதி"]),
    ("hi", "data_consent", "", None, ["मैं सहमत हूँ"]),
    ("hi", "sensitive_id", "", None, ["आधार नंबर"]),
]


def rows() -> list[tuple]:
    """The pack as rows of SCHEMA."""
    return [(lang, category, sub, phrase, attr, k) for lang, category, sub, attr, phrases in PACK for k, phrase in enumerate(phrases)]


def pack(spark: SparkSession) -> DataFrame:
    """The small pack, as a local relation: its size is known to the planner, which sends it to all executors."""
    return spark.sql(f"select lang, category, subcategory, phrase, cast(attr as string) as attr, cast(ord as int) as ord from ({pack_sql()})")


def pack_sql() -> str:
    """The small pack as the body of a common table expression."""
    quoted = lambda x: "null" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "select * from (values " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows()) + ") v(lang, category, subcategory, phrase, attr, ord)"


def normal_sql(text: str) -> str:
    """DuckDB SQL of ``functions.text.normal``."""
    return f"trim(regexp_replace(lower(nfc_normalize(translate(coalesce({text}, ''), '{UNSEEN}', ''))), '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'))"


def grams_sql() -> str:
    """Phrases of the small pack with their words (g), in DuckDB SQL over ``vocab``."""
    return f"select *, list_filter(string_split({normal_sql('phrase')}, ' '), lambda x: x <> '') as g from vocab"


def load(spark: SparkSession, path: str) -> DataFrame:
    """Nested JSON files (one for each language, named by it) as the long table; where there is none, an empty one.

    Lists of strings become phrases; maps add to the subcategory; a map's other
    strings become the attribute of its phrases.
    """
    files = spark.read.option("pathGlobFilter", "*.json").option("wholetext", True).text(path).select("value", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("lang"))
    top = files.select("lang", F.explode(F.from_json("value", "map<string,string>")).alias("category", "body"))
    flat = top.where(F.substring("body", 1, 1) == "[").select("lang", "category", F.lit("").alias("subcategory"), "body", F.lit(None).cast("string").alias("attr"))
    one = top.where(F.substring("body", 1, 1) == "{").select("lang", "category", F.explode(F.from_json("body", "map<string,string>")).alias("subcategory", "body"))
    lists = one.where(F.substring("body", 1, 1) == "[").select("lang", "category", "subcategory", "body", F.lit(None).cast("string").alias("attr"))
    deep = one.where(F.substring("body", 1, 1) == "{").select("lang", "category", F.col("subcategory").alias("outer"), F.explode(F.from_json("body", "map<string,string>")).alias("inner", "body"))
    attrs = deep.where(~F.substring("body", 1, 1).isin("[", "{")).groupBy("lang", "category", "outer", "inner").agg(F.min("body").alias("attr"))
    nested = deep.where(F.substring("body", 1, 1) == "[").join(attrs, ["lang", "category", "outer", "inner"], "left").select("lang", "category", F.concat_ws("/", "outer", "inner").alias("subcategory"), "body", "attr")
    every = flat.unionByName(lists).unionByName(nested)
    return every.select("lang", "category", "subcategory", F.posexplode(F.from_json("body", "array<string>")).alias("ord", "phrase"), "attr").select("lang", "category", "subcategory", "phrase", "attr", "ord")


def with_english(vocab: DataFrame, lang: str) -> DataFrame:
    """Phrases for a language: its own and, as speakers switch, the English ones; repeated phrases once, the language's own first."""
    wanted = vocab.where(F.col("lang").isin(lang, "en"))
    first = F.min(F.struct((F.col("lang") != lang).alias("foreign"), "ord", "lang", "attr")).alias("first")
    return wanted.groupBy("category", "subcategory", "phrase").agg(first).select("category", "subcategory", "phrase", "first.lang", "first.ord", "first.attr")
