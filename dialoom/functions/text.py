"""Column helpers for script-like text: patterns, stripping, style phrases, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The notation of scripts.
CHAPTER = (
    r"^(?:第[一二三四五六七八九十百千万零\d]+[章节部集卷篇]"
    r"|(?:Chapter|Chap\.?|Ch\.?|Part|Volume|Vol\.?|Book)\s*\d+"
    r"|(?:序章|前言|后记|尾声|番外|楔子|引子|序幕|终章|完结|番外篇|特别篇))"
    r"(?:[\s:：.．\-—]+.*)?$"
)
TRAILING_SPEAKER = r"^「([^」]*)」[\s—－-]*(.+)$"
TRAILING_SPEAKER_STRICT = r"^「([^」]*)」\s*[—－-][\s—－-]*(.+)$"
SPEAKER_PREFIX = r"^(.+?)：[「『](.*)$"
BARE_QUOTE = r"^「([^」]*)」\s*$"
INLINE_QUOTE = r"「([^」]*)」"
ANY_QUOTE = r"「(.*?)」"
BRACKET_SPEAKER = r"【([^】]*)】「"
NARRATOR = "旁白"
NON_PERSON = "非人物发声"
EMOTIONS = ["happy", "sad", "angry", "surprised", "calm", "nervous", "cold"]
TONES = ["loud", "soft", "stutter", "sarcastic", "gentle", "serious", "whisper"]
EMOTION_PHRASES = {"happy": "欢快活泼", "sad": "低落悲伤", "angry": "愤怒生气", "surprised": "惊讶震惊", "calm": "平静冷静", "nervous": "紧张焦虑", "cold": "冷漠淡漠"}
TONE_PHRASES = {"loud": "大声", "soft": "轻声", "whisper": "低语", "gentle": "温柔", "serious": "严肃", "sarcastic": "讽刺", "stutter": "结巴"}
#: Line ends, as text editors know them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Without white space at either end, that of other scripts included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_chapter(c: Column) -> Column:
    return c.rlike("(?iuU)" + CHAPTER)


def split_lines(c: Column) -> Column:
    """Lines of a text; a line end at the very end opens no further line."""
    parts = F.split(c, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def style_prefix(emotion: Column, tone: Column, paren: str = "()") -> Column:
    """Phrases of an emotion and a tone in parentheses; unknown parts are left out."""

    def phrase(c: Column, table: dict[str, str]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.coalesce(c, F.lit("")))

    both = F.concat_ws("，", phrase(emotion, EMOTION_PHRASES), phrase(tone, TONE_PHRASES))
    left, right = (paren[0], paren[1]) if paren else ("", "")
    return F.when(both == "", "").otherwise(F.concat(F.lit(left), both, F.lit(right)))


def synthesis_text(prefix: Column, text: Column, escape: bool = False) -> Column:
    """The text to be spoken, on one line."""
    out = F.replace(F.concat(prefix, text), F.lit("\n"), F.lit(" "))
    return F.replace(out, F.lit('"'), F.lit('\\"')) if escape else out


def segment_path(ord_: Column, speaker: Column | None = None) -> Column:
    return F.format_string("%05d.wav", ord_) if speaker is None else F.format_string("%05d_%s.wav", ord_, speaker)


def clock(seconds: Column) -> Column:
    """Epoch seconds as the time of day in UTC, ``hh:mm:ss``."""
    s = F.floor(seconds)
    return F.format_string("%02d:%02d:%02d", F.pmod(F.floor(s / 3600), F.lit(24)), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))


def date_and_clock(seconds: Column) -> Column:
    """Epoch seconds as ``yyyy-mm-dd hh:mm:ss`` in UTC."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int"))
    return F.concat_ws(" ", day.cast("string"), clock(seconds))


def confidence_flag(c: Column) -> Column:
    return F.when(c > 0.5, "✓").otherwise("?")


def format_duration(seconds: Column) -> Column:
    """Seconds as ``59.9s``, ``1.0min`` or ``1.0h``; ties round half up."""
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%.1fmin", seconds / 60))
        .otherwise(F.format_string("%.1fh", seconds / 3600))
    )


def preview(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def voice_gender(name: Column) -> Column:
    return F.when(F.lower(name).rlike("female|zira"), "female").otherwise("male")


def json_in_text(c: Column, schema: str) -> Column:
    """The first JSON object within free text; null if there is none or it is broken."""
    return F.from_json(F.regexp_extract(c, r"(?s)\{.*?\}", 0), schema)


def decode_arguments(c: Column) -> Column:
    """Arguments of a call; an empty map if they are no JSON object."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
