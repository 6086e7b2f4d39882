"""Column expressions for knowledge and conversation texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What redaction replaces, in order.
REDACTIONS = (
    ("SECRET", r"(?i)(?:\b(?:api[_-]?key|authorization|token|password|secret)\s*[:=]\s*|\bsk-)[^\s，。；,;]+"),
    ("PATH", r"(?:[A-Za-z]:[\\/][^\s，。；,;]+|/(?:Users|home|private|tmp|var)/[^\s，。；,;]+)"),
    ("ACCOUNT", r"(?i)\b(?:account|username|user|账号|用户)\s*[:=：]\s*[^\s，。；,;]+"),
    ("IP", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])"),
    ("EMAIL", r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"),
    ("DOMAIN", r"(?<![@\w])(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![\w-])"),
    ("CUSTOMER", r"\b[A-Z0-9][A-Z0-9_-]{2,}-(?:CUSTOMER|CLIENT)\b"),
    ("WORK_ORDER", r"(?i)\b(?:INC|WO|TICKET)[-_]?\d{4,}\b"),
)
#: Wording that tries to steer a reader model.
RISKS = (
    ("ignore_instructions", r"(?i)ignore\s+(?:all\s+)?previous\s+instructions"),
    ("reveal_prompt", r"(?i)reveal\s+(?:the\s+)?system\s+prompt"),
    ("ignore_instructions_zh", r"忽略(?:以上|之前|前面).{0,12}(?:指令|要求|提示)"),
    ("run_command_zh", r"(?i)(?:执行|运行).{0,12}(?:系统命令|shell|powershell)"),
)
#: Megabits per second of one of each bandwidth unit.
UNITS_MBPS = (
    ("mbps", 1.0), ("mb/s", 1.0), ("m", 1.0), ("兆", 1.0), ("gbps", 1000.0), ("gb/s", 1000.0), ("g", 1000.0), ("千兆", 1000.0),
    ("kbps", 0.001), ("kb/s", 0.001), ("k", 0.001),
)
#: How a unit is written, and the wording that leads a promised and a measured bandwidth.
BANDWIDTH_UNIT = r"(?:gbps?|gb/s|g|mbps?|mb/s|m|kbps?|kb/s|k|千兆|兆)"
STANDARD_LEAD, ACTUAL_LEAD = r"标准(?:带宽|速率)?\s*[:：=]?\s*", r"(?:实际|实测|当前)(?:带宽|速率)?\s*[:：=]?\s*"


def replaced(text: Column, pattern: str, make) -> Column:
    """The text with each match of ``pattern`` replaced by ``make(match)``: unlike ``regexp_replace``, any expression of it."""

    def fold(bound: Column) -> Column:
        pieces, found = F.split(bound, pattern, -1), F.regexp_extract_all(bound, F.lit(pattern), F.lit(0))
        joined = F.zip_with(pieces, F.transform(found, make), lambda piece, new: F.concat(piece, F.coalesce(new, F.lit(""))))
        return F.array_join(joined, "")

    # the text is bound by a lambda, so that chained replacements don't evaluate it twice each
    return F.get(F.transform(F.array(text), fold), F.lit(0))


def redacted(text: Column) -> Column:
    """Sensitive spans as ``<KIND:first 8 digits of the match's SHA-256>``: equal values stay recognisable as equal."""
    for kind, pattern in REDACTIONS:
        text = _redact(text, kind, pattern)
    return text


def _redact(text: Column, kind: str, pattern: str) -> Column:
    return replaced(text, pattern, lambda m: F.concat(F.lit(f"<{kind}:"), F.substring(F.sha2(m, 256), 1, 8), F.lit(">")))


def risk_flags(text: Column) -> Column:
    """The names of the risky wordings in a text, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), name) for name, pattern in RISKS]))


def paragraphs(text: Column) -> Column:
    """The non-empty parts between blank lines, trimmed."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def quotes(content: Column, quote: Column) -> Column:
    """Whether a text holds a quotation, white space apart."""
    return F.contains(squeezed(content), squeezed(quote))


def word_signs(text: Column) -> Column:
    """Letters and digits only, lower-cased, of any script."""
    return F.lower(F.regexp_replace(text, r"(?U)[\W_]+", ""))


def states_fact(answer: Column, fact: Column) -> Column:
    """Whether an answer holds a fact, signs and case apart; one without letters or digits is never held."""
    return (word_signs(fact) != "") & F.contains(word_signs(answer), word_signs(fact))


def _bandwidth(text: Column, lead: str) -> Column:
    pattern = rf"(?i){lead}([0-9]+(?:\.[0-9]+)?)\s*({BANDWIDTH_UNIT})?"
    number, unit = F.regexp_extract(text, pattern, 1), F.lower(F.regexp_extract(text, pattern, 2))
    factor = F.lit(1.0)  # without a unit, megabits
    for name, value in UNITS_MBPS:
        factor = F.when(unit == name, value).otherwise(factor)
    return F.nullif(number, F.lit("")).cast("double") * factor


def standard_bandwidth(text: Column) -> Column:
    """The promised megabits per second that a question names; null without one."""
    return _bandwidth(text, STANDARD_LEAD)


def actual_bandwidth(text: Column) -> Column:
    """The measured megabits per second that a question names; null without one."""
    return _bandwidth(text, ACTUAL_LEAD)


def bare_bandwidth(text: Column) -> Column:
    """Megabits per second of a text that is nothing but a figure with a unit; null otherwise."""
    return F.when(text.rlike(rf"(?i)^\s*[0-9]+(?:\.[0-9]+)?\s*{BANDWIDTH_UNIT}?\s*$"), _bandwidth(text, r"^\s*"))


#: Secrets and local paths of a chat and what stands for them; leads that a title drops; texts that say nothing; signs at its ends.
CHAT_SECRET = r"(?i)(?:sk-[a-z0-9_-]{12,}|(?:api[_-]?key|authorization)\s*[:=]\s*\S+)"
CHAT_PATH = r"(?i)(?<!\w)(?:[a-z]:[\\/]|/users/|/home/|/private/|/tmp/|~[/\\])[^\n，。；,;!?]*"
SECRET_MARK, PATH_MARK, PATH_NAME = "<敏感信息已隐藏>", "<本地路径已隐藏>", "报文文件"
TITLE_LEAD = r"^(?:你好[，,。!！\s]*|请问[，,：:\s]*|请帮我|帮我|麻烦(?:帮我)?|我想(?:了解|知道|问一下)|请(?:分析|解释|看看|检查)|分析(?:一下)?)"
NO_TITLE = r"(?i)^(?:你好|您好|嗨|hi|hello|谢谢|好的|可以|确认|继续|重试|\d+(?:\.\d+)?[a-z]*)[。.!！]?$"
CAPTURE_TITLE = "报文测速诊断"
LEAD_ENDS, TITLE_ENDS = " ，,：:。.!！?？", " ，,：:。.!！?？-_"
TITLE_SIGNS = 28


def hidden(text: Column) -> Column:
    """A chat text with secrets and local paths replaced by marks."""
    return F.regexp_replace(F.regexp_replace(text, CHAT_SECRET, SECRET_MARK), CHAT_PATH, PATH_MARK)


def title(text: Column, has_capture: Column | None = None) -> Column:
    """A title from a first message: its first sentence without leads, of 28 signs at most; null if it says nothing.

    With a capture at hand, a message that says nothing has a title all the same.
    """
    none = F.lit(None).cast("string") if has_capture is None else F.when(has_capture, CAPTURE_TITLE)
    plain = squeezed(hidden(text))
    short = plain
    for _ in range(3):
        short = F.btrim(F.regexp_replace(short, TITLE_LEAD, ""), F.lit(LEAD_ENDS))
    short = F.replace(F.replace(short, F.lit(PATH_MARK), F.lit(PATH_NAME)), F.lit(SECRET_MARK), F.lit(""))
    short = F.btrim(F.get(F.split(short, r"[\n。！？!?；;]", 2), F.lit(0)), F.lit(TITLE_ENDS))
    says_nothing = plain.rlike(NO_TITLE) | (short == "") | short.rlike(NO_TITLE)
    if has_capture is not None:
        says_nothing = says_nothing | (has_capture & (F.length(short) < 4))
    cut = F.concat(F.rtrim(F.substring(short, 1, TITLE_SIGNS - 1)), F.lit("…"))
    return F.when(says_nothing, none).when(F.length(short) <= TITLE_SIGNS, short).otherwise(cut)


#: Fixed value: the slash commands of a chat.
COMMANDS = ("new", "report", "evidence", "save", "help", "quit")


def command(text: Column, known: tuple[str, ...] = COMMANDS) -> Column:
    """struct(name, argument) of a chat line: ``empty`` for a blank one, ``unknown`` for a command that isn't known; null for anything else."""
    plain, pattern = F.btrim(text, F.lit(" \t\r\n")), r"(?s)^/\s*(\S*)\s*(.*)$"
    name = F.lower(F.regexp_extract(plain, pattern, 1))
    found = F.struct(F.when(name.isin(*known), name).otherwise("unknown").alias("name"), F.regexp_extract(plain, pattern, 2).alias("argument"))
    return F.when(plain == "", F.struct(F.lit("empty").alias("name"), F.lit("").alias("argument"))).when(F.startswith(plain, F.lit("/")), found)


#: Wording of a chat turn that sets a diagnosis going, that names its parameters, that asks about a result.
PARAMETER_TERMS = ("标准带宽", "标准速率", "实际带宽", "实际速率", "实测带宽", "上行", "上传", "下载")
DIAGNOSIS_TERMS = ("分析", "诊断", "不达标", "测速异常")
RESULT_TERMS = (
    "原因", "为什么", "主因", "证据", "报告", "结果", "建议", "重传", "窗口", "rtt", "流", "卡顿", "异常", "域名", "dns", "cname", "tls", "http", "quic", "报文", "ip",
)
SHORT_PARAMETER = r"^\s*[0-9]+(?:\.[0-9]+)?\s*(?:g|m|k|gbps?|mbps?|kbps?|兆|千兆)?\s*$"


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def route(text: Column, has_analysis: Column, has_pending: Column) -> Column:
    """Where a chat turn goes: analysis_question, diagnosis or general."""
    plain = F.lower(F.trim(text))
    asked = F.when(_any(plain, RESULT_TERMS), "analysis_question").otherwise("general")
    starts = F.contains(plain, F.lit(".pcap")) | _any(plain, PARAMETER_TERMS + DIAGNOSIS_TERMS) | (has_pending & plain.rlike(SHORT_PARAMETER))
    return F.when(has_analysis, asked).when(starts, "diagnosis").otherwise("general")


def is_english(text: Column) -> Column:
    """Whether a text is English narrative: Latin words and no CJK signs; two words, or one of ten letters; not just short names in capitals."""
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    letters = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))
    names = F.forall(words, lambda w: (F.upper(w) == w) & (F.length(w) <= 8))
    return ~text.rlike("[\\x{4e00}-\\x{9fff}]") & (F.size(words) > 0) & ~names & ((F.size(words) >= 2) | (letters >= 10))


def whole_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else. Null is none.

    Spark's parser takes no notice of what follows a value: within brackets only a closing one can follow, within
    braces only a closing brace, so what passes both is whole.
    """
    listed, named = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return listed.isNotNull() & named.isNotNull() & F.try_variant_get(listed, "$[0]", "variant").isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()


def embedded_object(text: Column) -> Column:
    """The JSON object that a text holds, from its first ``{`` to its last ``}``, past a fence around it; null if that is no object."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[^\n]*(?:\n|$)", ""), r"\n\s*```\s*$", ""))
    whole = F.regexp_extract(plain, r"(?s)\{.*\}", 0)
    return F.when((whole != "") & whole_json(whole), whole)


def utf8_tail(text: Column, most: int) -> Column:
    """The end of a text that fits ``most`` bytes, cut between signs."""
    data = F.to_binary(text, F.lit("utf-8"))
    size = F.octet_length(text)
    end = F.substr(data, size - most + 1, F.lit(most))
    # up to three bytes of a sign that was cut stand first
    left = F.length(F.regexp_extract(F.hex(end), "^(?:[89AB].)*", 0)) / 2
    return F.when(size <= most, text).otherwise(F.substr(end, F.least(left, F.lit(3)).cast("int") + 1, F.lit(most)).cast("string"))


def estimated_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Cost at prices per million tokens; null if a count is missing."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 6)
