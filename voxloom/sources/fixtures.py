"""A corpus of calls in templates, derived from orders and lineitem; its SQL runs on Spark and on DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

# The utterances.
TEMPLATES = [
    "Good morning, my name is Priya calling from the lender about your loan account, this call may be recorded",
    "Your EMI of {amt} rupees is overdue by {qty} days, the outstanding balance is {amt} rupees",
    "I will pay {amt} rupees by Friday",
    "We will send our people to your house right now, this is your last chance",
    "Please tell me the OTP and confirm your account number {acct}",
    "No, I refuse, I cannot pay this, it is a wrong charge",
    "Let me speak to your manager, please stop calling me",
    "My PAN is ABCDE{pan}F and the interest rate is {rate} percent",
    "Okay",
    "Revenue growth was strong but there is a risk of decline",
    "I need two more weeks, could you extend the due date",
    "Yes, I agree, that works, you can share the statement with me",
    "My Aadhaar is 2345 6789 0124 for verification",
    "The number I have is 234567890127 for verification",
    "Pay to ravi{qty}@okaxis or use IFSC HDFC0{ifsc} for the transfer",
    "Call me back on +91{phone} or write to user{qty}@example.org",
    "I can arrange ten thousand rupees next Monday",
    "The loan is 5 lakh and the second loan is 3 lakh, with 36 months tenure",
    "Sir, your me of {amt} rupees and the kayak form are pending",
    "Install the remote desktop app and share your screen immediately",
    "We are from the tax department, there is an arrest warrant, act fast",
    "We spoke to your wife about the debt and we will tell your employer",
    "To verify your identity, do you consent to share your date of birth, you may withdraw your consent",
    "Give me your card number and the CVV",
    "Main Friday tak paanch hazaar rupaye jama kar dunga",
    "Haan ji",
    "We expect revenue of {usd}{rate}.5 million next quarter, forward-looking statements are subject to risk",
    "This is unacceptable service, I will complain about the harassment",
    "The payment was made on 15/03/2024 against reference AB{ifsc}C",
    "foreign foreign",
    "Thank you, Priya, over to you",
    "What is the due date?",
    "अगर पैसे नहीं दिए तो घर पर आदमी भेजेंगे, ओटीपी बताइए",
    "फोन मत करो, मैं ₹ {amt} कल दूँगा",
    "உடனே பணம் கட்டுங்கள், வீட்டுக்கு ஆள் அனுப்புவோம்",
    "இது வேண்டாம், வீட்டுக்கு ஆள்",
    "அனுப்புவோம் என்று சொன்னேன், உங்கள் பிறந்த தேதி என்ன?",
    "\u0915\u093cर्\u091c\u093c बाकी है, किस्त भरिए, यह कॉल रिकॉर्ड हो",
    "रही है, आधार नंबर बताइए, मैं सहमत हूँ",
    "If nobody pays then we will send our",
    "people to your house, so please stop calling",
    "me, I said it before, please leave me",
    "alone, I will pay 500 today from my account",
    "आपके account की जानकारी नहीं दूँगा",
]


def segments_sql(lineitem: str = "lineitem", orders: str = "orders") -> str:
    """Common table expressions up to ``segments``."""
    values = ", ".join("({}, '{}')".format(k, t.replace("'", "''")) for k, t in enumerate(TEMPLATES))
    fields = {"{usd}": "'$'", "{amt}": "cast(amt as varchar(20))", "{qty}": "cast(qty as varchar(20))", "{acct}": "cast(1000000000 + pk*7 as varchar(20))", "{pan}": "cast(1000 + pk % 9000 as varchar(20))", "{rate}": "cast(rate as varchar(20))", "{ifsc}": "cast(100000 + pk % 900000 as varchar(20))", "{phone}": "cast(9000000000 + pk*13 as varchar(20))"}
    text = "tpl.tpl"
    for name, value in fields.items():
        text = f"replace({text}, '{name}', {value})"
    return f"""tpl(tid, tpl) as (select * from (values {values}) v(tid, tpl)),
    ordered_lines as (select *, row_number() over (partition by l_orderkey
        order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_shipdate) - 1 as rn from {lineitem}),
    spoken as (select l_orderkey as call_id, cast(rn as int) as segment_id,
        case when rn % 7 = 6 then 'SPEAKER_02' when rn % 2 = 0 then 'SPEAKER_00' else 'SPEAKER_01' end as speaker,
        cast(coalesce(sum(cast(floor(l_quantity) as int)) over (partition by l_orderkey order by rn rows between unbounded preceding and 1 preceding), 0) as double) as start_s,
        cast(sum(cast(floor(l_quantity) as int)) over (partition by l_orderkey order by rn rows between unbounded preceding and current row) as double) as end_s,
        case when rn = 0 and l_orderkey % 3 <> 0 then 0 else (l_partkey + 7*l_suppkey + 5*rn) % {len(TEMPLATES)} end as tid,
        cast(floor(l_extendedprice) as bigint) as amt, cast(floor(l_quantity) as int) as qty,
        cast(floor(l_discount*100+0.5) as int) as rate, l_partkey as pk,
        (cast(floor(l_quantity) as int) * 37 + l_partkey * 11) % 100 as cpct from ordered_lines),
    segments as (select spoken.call_id, spoken.segment_id, spoken.speaker, spoken.start_s, spoken.end_s, spoken.cpct / cast(100 as double) as confidence,
        {text} as text,
        case o.o_orderpriority when '1-URGENT' then 'collections' when '2-HIGH' then 'kyc' when '3-MEDIUM' then 'complaint' when '4-NOT SPECIFIED' then 'general' else 'onboarding' end as call_type
        from spoken join tpl on spoken.tid = tpl.tid join {orders} o on o.o_orderkey = spoken.call_id)"""


#: Orders that make up one long call: their number grows with the input, their length doesn't.
LONG = 400
LONG_SQL = f"""segments_long as (select cast(floor(call_id / {LONG}) as bigint) as call_id,
        cast(row_number() over (partition by floor(call_id / {LONG}) order by call_id, segment_id) - 1 as int) as segment_id, speaker,
        sum(end_s - start_s) over (partition by floor(call_id / {LONG}) order by call_id, segment_id rows between unbounded preceding and current row) - (end_s - start_s) as start_s,
        sum(end_s - start_s) over (partition by floor(call_id / {LONG}) order by call_id, segment_id rows between unbounded preceding and current row) as end_s,
        confidence, text,
        case cast(floor(call_id / {LONG}) as bigint) % 5 when 0 then 'collections' when 1 then 'kyc' when 2 then 'complaint' when 3 then 'general' else 'onboarding' end as call_type from segments)"""


def emotions_sql(source: str = "segments") -> str:
    """Emotion annotations of segments."""
    return f"""emotions as (select call_id, segment_id, speaker,
        case (call_id + 3*segment_id + tlen) % 8 when 0 then 'angry' when 1 then 'disgusted' when 2 then 'fearful' when 3 then 'happy' when 4 then 'sad' when 5 then 'surprised' else 'neutral' end as emotion,
        cast((call_id*13 + segment_id*29 + tlen*7) % 101 as double) / cast(100 as double) as emotion_score from (select *, length(text) as tlen from {source}) q)"""


FRAMES_SQL = """frames as (select user_id as series_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as frame_idx,
        (row_number() over (partition by user_id order by ts, event_id) - 1) * cast(0.01 as double) as t, value as energy from events)"""


#: Segments of long calls that one task works on.
SHARE = 100_000


class Corpus:
    """The fixture tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._written: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """A supplied table."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _views(self, *names: str) -> None:
        for name in names:
            self.table(name).createOrReplaceTempView(f"vx_{name}")

    def segments(self) -> DataFrame:
        """Segments of short calls."""
        self._views("lineitem", "orders")
        return self.spark.sql(f"with {segments_sql('vx_lineitem', 'vx_orders')} select * from segments")

    def segments_long(self) -> DataFrame:
        """Segments of long calls, each of LONG orders, as in LONG_SQL.

        Partitions grow with the rows, so that a task sorts SHARE of them whatever
        the input's size. Adaptive execution goes by bytes shuffled, which are a
        fraction of what the sorts hold, and would join partitions.
        """
        self._views("orders")
        lines = self.table("lineitem")
        parts = lines.count() // SHARE + 1
        lines.repartition(parts, "l_orderkey").createOrReplaceTempView("vx_lineitem_parts")
        rows = self.spark.sql(f"with {segments_sql('vx_lineitem_parts', 'vx_orders')} select * from segments")
        rows = rows.withColumn("_long", F.floor(F.col("call_id") / LONG)).repartition(parts, "_long")
        order = Window.partitionBy("_long").orderBy("call_id", "segment_id")
        length = F.col("end_s") - F.col("start_s")
        spent = F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, 0))
        kinds = F.array(*map(F.lit, ("collections", "kyc", "complaint", "general", "onboarding")))
        kind = F.get(kinds, F.pmod(F.col("_long"), F.lit(5)).cast("int"))
        place = F.row_number().over(order) - 1
        return rows.select(F.col("_long").alias("call_id"), place.alias("segment_id"), "speaker", (spent - length).alias("start_s"), spent.alias("end_s"), "confidence", "text", kind.alias("call_type"))

    def spoken(self) -> DataFrame:
        """Segments of short calls, written once a query: for those that read them several times or filter by what follows from the text.

        Catalyst would put the expressions that make up a text into filters and join
        conditions, once for each place where it stands, and make it anew for each reader.
        """
        if "spoken" not in self._written:
            self._written["spoken"] = written(self.segments(), "segments")
        return self._written["spoken"]

    def spoken_long(self) -> DataFrame:
        """Segments of long calls, written once a query."""
        if "long" not in self._written:
            self._written["long"] = written(self.segments_long(), "segments_long")
        return self._written["long"]

    def emotions(self, source: DataFrame | None = None) -> DataFrame:
        """Emotions of the segments."""
        (source if source is not None else self.segments()).createOrReplaceTempView("vx_spoken")
        return self.spark.sql(f"with {emotions_sql('vx_spoken')} select * from emotions")

    def frames(self) -> DataFrame:
        """Frames of series."""
        self._views("events")
        return self.spark.sql(f"with {FRAMES_SQL.replace('from events', 'from vx_events')} select * from frames")
