"""All queries of the library and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import audio, casting, context, keywords, labeling, parsing, stats, timeline
from .plans import jobs
from .sources import derived as D
from .sources import listing
from .sources import scripts as S
from .sources.shared import new_folder, write_files

_STRIP = r"'^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g'"
_NAMES = ", ".join(f"'{x}'" for x in ("user", "assistant", T.NARRATOR, T.NON_PERSON, "guest"))


def _phrases(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


BASE = rf"""
WITH raw AS (
  SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM conversations
), lines AS (
  SELECT conv_id AS book_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS line_no,
    CASE WHEN turn IN (0,4) AND pos=0 THEN 'Chapter ' || (CASE WHEN turn=0 THEN '1' ELSE '2' END) || ': ' || raw
     WHEN pos%5=0 THEN '「'||raw||'」' WHEN pos%5=1 THEN '「'||raw||'」——'||role WHEN pos%5=2 THEN role||'：「'||raw||'」'
     WHEN pos%5=3 THEN 'x「'||raw||'」y「'||role||'」' WHEN turn%4=3 THEN '  ' WHEN turn%4=1 THEN substr(raw,1,4) ELSE raw END AS line
  FROM raw
), labels AS (
  SELECT book_id, unnest(range(10)) AS ord, [{_NAMES}][(unnest(range(10)) % 5 + 1)::INT] AS label FROM (SELECT DISTINCT conv_id AS book_id FROM conversations)
), stripped AS (SELECT *, regexp_replace(line, {_STRIP}) AS s FROM lines
), kinds AS (
  SELECT *, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '(?i){T.CHAPTER}') THEN 'chapter' WHEN regexp_matches(s, '{T.TRAILING_SPEAKER}') THEN 'trailing'
    WHEN regexp_matches(s, '{T.SPEAKER_PREFIX}') THEN 'prefix' WHEN regexp_matches(s, '{T.BARE_QUOTE}') THEN 'bare' WHEN regexp_matches(s, '{T.INLINE_QUOTE}') THEN 'inline' ELSE 'narrative' END AS rule
  FROM stripped
), parsed AS (
  SELECT book_id, line_no, CASE WHEN rule IN ('trailing','prefix','bare','inline') THEN 'dialogue' ELSE rule END AS kind,
    regexp_replace(CASE rule WHEN 'trailing' THEN regexp_extract(s, '{T.TRAILING_SPEAKER}', 1) WHEN 'prefix' THEN regexp_replace(regexp_extract(s, '{T.SPEAKER_PREFIX}', 2), '」$', '')
      WHEN 'bare' THEN regexp_extract(s, '{T.BARE_QUOTE}', 1) WHEN 'inline' THEN regexp_extract(s, '{T.INLINE_QUOTE}', 1) ELSE s END, {_STRIP}) AS text,
    regexp_replace(CASE rule WHEN 'trailing' THEN regexp_extract(s, '{T.TRAILING_SPEAKER}', 2) WHEN 'prefix' THEN regexp_extract(s, '{T.SPEAKER_PREFIX}', 1) ELSE '' END, {_STRIP}) AS speaker
  FROM kinds
), filled AS (
  SELECT *, coalesce(last_value(CASE WHEN kind='chapter' THEN text END IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), '') AS chapter FROM parsed
), counted AS (
  SELECT *, CASE WHEN kind='dialogue' THEN sum((kind='dialogue')::INT) OVER (PARTITION BY book_id ORDER BY line_no) - 1 END AS k FROM filled
), aligned AS (
  SELECT c.book_id, line_no, kind, text, chapter, CASE WHEN l.ord IS NULL THEN speaker WHEN label = '{T.NON_PERSON}' THEN '' ELSE label END AS speaker
  FROM counted c LEFT JOIN labels l ON l.book_id = c.book_id AND l.ord = c.k
), kept AS (
  SELECT book_id, line_no, kind, chapter, text, CASE WHEN kind='narrative' THEN '{T.NARRATOR}' ELSE speaker END AS speaker
  FROM aligned WHERE kind='dialogue' OR (kind='narrative' AND length(text) > 5)
), dialogues AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY line_no) - 1 AS ord, line_no, chapter, text, speaker FROM kept
), quotes AS (
  SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY line_no, pos) - 1 AS k, line_no, text FROM (
    SELECT book_id, line_no, unnest(regexp_extract_all(line, '{T.ANY_QUOTE}', 1)) AS text, generate_subscripts(regexp_extract_all(line, '{T.ANY_QUOTE}', 1), 1) AS pos FROM lines)
), genders(speaker, gender, confidence) AS (VALUES ('assistant','male',0.95::DOUBLE), ('user','female',0.7::DOUBLE)
), gendered AS (SELECT d.*, coalesce(g.gender, 'male') AS gender FROM dialogues d LEFT JOIN genders g USING (speaker)
), cast_map(who, ref) AS (VALUES ('assistant','a.wav'), ('{T.NARRATOR}','n.wav')
), voiced AS (
  SELECT g.*, coalesce(ref, CASE WHEN gender='female' THEN 'f.wav' ELSE 'm.wav' END) AS ref_audio
  FROM gendered g LEFT JOIN cast_map ON who = CASE WHEN speaker='' THEN '{T.NARRATOR}' ELSE speaker END
), emotions AS (
  SELECT book_id, ord, {T.EMOTIONS}[(ord%7+1)::INT] AS emotion, {T.TONES}[(ord%5+1)::INT] AS tone, 0.5::DOUBLE AS confidence,
    CASE WHEN ord%6=5 THEN 'Error: none' ELSE 'line ' || line_no END AS evidence FROM dialogues WHERE ord%4 <> 3
), moods AS (
  SELECT v.*, CASE WHEN speaker NOT IN ('', '{T.NARRATOR}') THEN emotion END AS emotion, CASE WHEN speaker NOT IN ('', '{T.NARRATOR}') THEN tone END AS tone
  FROM voiced v LEFT JOIN emotions e USING (book_id, ord)
), styled AS (
  SELECT *, concat_ws('，', {_phrases(T.EMOTION_PHRASES)}[emotion], {_phrases(T.TONE_PHRASES)}[tone]) AS phrase FROM moods
), files AS (
  SELECT book_id, ord, printf('%05d.wav', ord) AS path, CASE WHEN ord%9=0 THEN 0 ELSE ord+1000 END::BIGINT AS length, (ord*7+ord%5*40+1700000000)::BIGINT AS modified_s FROM dialogues WHERE ord%3=0
), segments AS (SELECT book_id, ord, line_no, chapter, speaker, (60*length(text))::BIGINT AS duration_ms FROM dialogues
), run_log AS (
  SELECT book_id, ord, CASE WHEN ord%2=0 THEN 'clone' ELSE 'preset' END AS engine, (ord%7+1)*0.5::DOUBLE AS seconds, CASE WHEN ord%6=5 THEN 'error' ELSE 'ok' END AS status FROM dialogues
), results AS (SELECT book_id, ord, status FROM run_log WHERE ord%4 <> 3
), gaps AS (
  SELECT *, CASE WHEN lag(chapter) OVER w IS NULL THEN 0 WHEN lag(chapter) OVER w <> chapter THEN 2000 ELSE 300 END::BIGINT AS gap_ms FROM segments WINDOW w AS (PARTITION BY book_id ORDER BY ord)
), timeline AS (SELECT *, (sum(gap_ms+duration_ms) OVER (PARTITION BY book_id ORDER BY ord))::BIGINT AS end_ms FROM gaps
), frames AS (SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value AS rms FROM events
), marked AS (
  SELECT *, rms > 40.0 AS loud, (rms > 40.0 AND NOT coalesce(lag(rms > 40.0) OVER w, false))::INT AS new, coalesce(lead(frame_idx) OVER w, frame_idx) AS nxt
  FROM frames WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)
), regions AS (
  SELECT clip_id, (min(frame_idx)*100)::BIGINT AS start_ms, (max(nxt)*100)::BIGINT AS end_ms FROM (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS run FROM marked) WHERE loud GROUP BY clip_id, run
), joined AS (
  SELECT clip_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY start_ms) AS run FROM (
    SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY clip_id ORDER BY start_ms) < 300 THEN 0 ELSE 1 END AS new FROM regions)) GROUP BY clip_id, run
), clips AS (
  SELECT clip_id, start_ms, end_ms, (coalesce(sum(end_ms-start_ms+100) OVER (PARTITION BY clip_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS clip_start FROM joined
), doc_lines AS (
  SELECT doc_id AS book_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents
), words(keyword) AS (VALUES ('the'), ('there'), ('ent')
), found AS (
  SELECT keyword, book_id, line_no, substr(regexp_replace(line, {_STRIP}), 1, 120) AS line, count(*) OVER (PARTITION BY keyword, book_id) AS total, row_number() OVER (PARTITION BY keyword, book_id ORDER BY line_no) AS rn
  FROM doc_lines JOIN words ON contains(line, keyword)
), mentions AS (
  SELECT keyword, book_id, line_no, substr(s, 1, 120) AS line, count(*) OVER (PARTITION BY keyword, book_id) AS total, row_number() OVER (PARTITION BY keyword, book_id ORDER BY line_no) AS rn
  FROM stripped JOIN (VALUES ('user'), ('assistant')) n(keyword) ON contains(s, keyword) WHERE contains(s, '「')
), ctx AS (
  SELECT d.book_id, d.ord, string_agg(l.line_no || ': ' || regexp_replace(l.line, {_STRIP}), chr(10) ORDER BY l.line_no) AS context
  FROM dialogues d JOIN lines l ON l.book_id = d.book_id AND l.line_no BETWEEN d.line_no - 30 AND d.line_no + 30 GROUP BY ALL
), corpus AS (
  SELECT book_id, speaker, string_agg(text, chr(10) ORDER BY ord) AS corpus, count(*) AS lines
  FROM (SELECT *, row_number() OVER (PARTITION BY book_id, speaker ORDER BY ord) AS rn FROM dialogues WHERE speaker <> '') WHERE rn <= 50 GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, first_ord) AS rank FROM (SELECT book_id, speaker, count(*) AS n, min(ord) AS first_ord FROM dialogues GROUP BY ALL)
), speakers AS (
  SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, first_ord) AS rank FROM (SELECT book_id, speaker, count(*) AS n, min(ord) AS first_ord FROM dialogues WHERE speaker <> '' GROUP BY ALL)
), asked AS (
  SELECT DISTINCT book_id, (book_id % 3 * 2 - 1)::BIGINT AS "start", CASE book_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 400 END::BIGINT AS "end" FROM doc_lines
  UNION ALL SELECT -7, 1, 10
), ranges AS (
  SELECT a.book_id, "start", "end", coalesce(string_agg(line_no || ': ' || regexp_replace(line, {_STRIP}), chr(10) ORDER BY line_no)
      FILTER (WHERE line_no BETWEEN greatest("start", 1) AND least("end", greatest("start", 1) + 299)), '') AS text,
    coalesce(least("end", max(line_no)) - greatest("start", 1) + 1 > 300, false) AS truncated
  FROM asked a LEFT JOIN doc_lines l ON l.book_id = a.book_id GROUP BY a.book_id, "start", "end"
), volume AS (
  SELECT d.book_id, d.ord, d.chapter, CASE WHEN status='ok' THEN 'clone' ELSE 'fallback' END AS engine, d.ord%3=0 AND d.ord%9<>0 AS readable,
    CASE WHEN status='ok' AND d.ord%3=0 AND d.ord%9<>0 THEN duration_ms ELSE 1000 END::BIGINT AS duration_ms
  FROM segments d LEFT JOIN results r USING (book_id, ord)
), volume_gaps AS (
  SELECT *, CASE WHEN lag(chapter) OVER w IS NULL THEN 0 WHEN lag(chapter) OVER w <> chapter THEN 2000 ELSE 300 END::BIGINT AS gap_ms FROM volume WINDOW w AS (PARTITION BY book_id ORDER BY ord)
), volume_line AS (SELECT *, (sum(gap_ms + duration_ms) OVER (PARTITION BY book_id ORDER BY ord))::BIGINT AS end_ms FROM volume_gaps
), hops AS (SELECT clip_id, frame_idx // 4 AS h, sum(rms * rms) AS e FROM frames GROUP BY ALL
), all_hops AS (SELECT clip_id, unnest(range((max(frame_idx) + 1) // 4 + 1)) AS h FROM frames GROUP BY clip_id
), levels AS (
  SELECT clip_id, h AS frame_idx, sqrt(sum(coalesce(e, 0)) OVER (PARTITION BY clip_id ORDER BY h ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 16) AS rms FROM all_hops LEFT JOIN hops USING (clip_id, h)
), level_marks AS (
  SELECT *, rms > 45.0 AS loud, (rms > 45.0 AND NOT coalesce(lag(rms > 45.0) OVER w, false))::INT AS new, coalesce(lead(frame_idx) OVER w, frame_idx) AS nxt
  FROM levels WINDOW w AS (PARTITION BY clip_id ORDER BY frame_idx)
), level_regions AS (
  SELECT clip_id, (min(frame_idx)*100)::BIGINT AS start_ms, (max(nxt)*100)::BIGINT AS end_ms FROM (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY frame_idx) AS run FROM level_marks) WHERE loud GROUP BY clip_id, run
), level_joined AS (
  SELECT clip_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (SELECT *, sum(new) OVER (PARTITION BY clip_id ORDER BY start_ms) AS run FROM (
    SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY clip_id ORDER BY start_ms) < 300 THEN 0 ELSE 1 END AS new FROM level_regions)) GROUP BY clip_id, run
)
"""

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _op(name: str, query: Query, sql: str | None) -> None:
    _queries[name] = query
    if sql is not None:
        _sql[name] = BASE + sql


def _write_books(s: SparkSession, d: str, rows: DataFrame, order: str, path: str) -> None:
    """A text file for each book, in a folder of its own."""
    books = D.table(s, d, "conversations").select("conv_id").distinct().count()
    named = rows.select(F.concat(F.lit("book_id="), "book_id").alias("folder"), F.lit("text.txt").alias("name"), F.col("line").alias("value"), order)
    write_files(named, books, path, [order])


def _written_lines(s: SparkSession, d: str) -> DataFrame:
    """Books as text files in the shared folder, one folder a book, read back."""
    path = new_folder(s, "books")
    _write_books(s, d, D.lines(s, d), "line_no", path)
    return S.read_lines(s, path)


def _written_labels(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "labels")
    _write_books(s, d, D.labels(s, d).select("book_id", "ord", F.concat(F.lit("\n"), "label").alias("line")), "ord", path)
    return S.read_speaker_labels(s, path)


def _genders_of(s: SparkSession, d: str) -> DataFrame:
    return D.dialogues(s, d).select("book_id", "speaker").distinct().join(F.broadcast(D.genders(s)), "speaker")


def _written_json(s: SparkSession, df: DataFrame) -> str:
    path = new_folder(s, "json")
    S.write_labels_json(df, path)
    return path


def _genders_read(s: SparkSession, d: str) -> DataFrame:
    return S.read_gender_results(s, _written_json(s, S.gender_json(_genders_of(s, d), ["book_id"])), per_line=True)


def _emotion_files(s: SparkSession, d: str) -> DataFrame:
    """Results of either shape, by the parity of the book, written and read back."""
    e = D.emotions(s, d)
    both = S.emotion_json(e.where("book_id % 2 = 0"), ["book_id"], "map").union(S.emotion_json(e.where("book_id % 2 = 1"), ["book_id"], "list"))
    return S.read_emotion_results(s, _written_json(s, both), per_line=True)


def _label_file(s: SparkSession, d: str) -> DataFrame:
    """All that a file of the list shape says: totals and rows."""
    path = _written_json(s, S.emotion_json(D.emotions(s, d), ["book_id"], "list"))
    body = "total long, success long, fail long, emotions array<string>, tones array<string>, results array<" + S.EMOTION_ROW + ">"
    back = s.read.schema("book_id long, value string").json(path).select("book_id", F.from_json("value", body).alias("v"))
    head = [F.col(f"v.{c}").alias(c) for c in ("total", "success", "fail")]
    listed = [F.array_join("v.emotions", " ").alias("emotions"), F.array_join("v.tones", " ").alias("tones")]
    rows = back.select("book_id", *head, *listed, F.explode("v.results").alias("r"))
    return rows.select("book_id", "total", "success", "fail", "emotions", "tones", F.col("r.index").alias("ord"), *[F.col(f"r.{c}").alias(c) for c in ("emotion", "tone", "confidence", "evidence")])


#: The number and the book of a segment's file.
NUMBER = r"/(\d+)[^/]*\.wav$"
BOOK = r"/book(\d+)/[^/]*$"


def _write_segments(files: DataFrame, path: str, value: Column) -> None:
    """A file for each segment, named by its number, in a folder for each book."""
    named = files.select(F.concat(F.lit("book"), "book_id").alias("folder"), F.format_string("%05d.wav", "ord").alias("name"), value.alias("value"))
    write_files(named, files.count(), path)


def _segment_files(s: SparkSession, d: str) -> DataFrame:
    """Files with names that end in ``.wav``, listed without contents."""
    path = new_folder(s, "segments")
    _write_segments(D.files(s, d, D.written_dialogues(s, d)), path, F.repeat(F.lit("x"), (F.col("length") % 7 + 1).cast("int")))
    return S.scan_segment_files(s, path, NUMBER).select("ord", F.regexp_extract("path", BOOK, 1).cast("long").alias("book_id"), "length")


def _segments_back(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "manifest")
    rows = jobs.dry_run_segments(D.dialogues(s, d))
    S.write_segments(rows, path)
    return S.read_segments(s, path).select("book_id", "ord", "chapter", "speaker", "audio_path")


STAMP = datetime(2024, 2, 29, 12, 30)
SHOWN = {
    "projects": ["name", "status", "created_at"], "characters": ["name", "gender", "dialogue_count", "project_id"], "dialogues": ["chapter", "text", "speaker", "order", "project_id"],
    "audio_files": ["file_path", "source", "character_id", "created_at"],
}


def _tables_back(s: SparkSession, d: str) -> DataFrame:
    """The four tables as they are read back, under common columns; verdicts are by book, and two books differ in theirs."""
    path = new_folder(s, "tables")
    dialogues = D.dialogues(s, d)
    people = casting.join_gender(dialogues, D.genders(s)).select("book_id", "speaker", "gender").distinct()
    audio = S.character_audio(casting.cast_voice(people, *S.casting_tables(s, D.CAST)))
    state = dialogues.select("book_id", F.when(F.col("book_id") % 2 == 0, "done").otherwise("parsed").alias("status")).distinct()
    S.write_tables(S.relational_tables(dialogues, _book_genders(s, d), audio, STAMP, state), path)
    out = None
    for name, columns in SHOWN.items():
        cells = [F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c == "created_at" else F.col(f"`{c}`").cast("string") for c in columns]
        t = s.read.parquet(f"{path}/{name}").select(F.lit(name).alias("table"), "id", F.concat_ws("|", *cells).alias("row"))
        out = t if out is None else out.union(t)
    return out


def _registry(s: SparkSession, d: str) -> DataFrame:
    """Voices in two versions of a registry, its list file read back."""
    root, path = new_folder(s, "registry"), new_folder(s, "voices")
    v = _voice_rows(s, d).withColumn("metadata", F.create_map(F.lit("seq"), F.col("seq").cast("string"), F.lit("parity"), (F.col("seq") % 2).cast("string")))
    S.merge_voices(v.where("seq % 2 = 0"), root)
    S.merge_voices(v.where("seq % 2 = 1"), root)
    S.write_voice_list(S.read_registry(s, root), path)
    back = S.read_voices(s, path)
    return back.select("voice_id", "voice_name", "ref_audio_path", F.col("metadata")["seq"].alias("seq"), F.col("metadata")["parity"].alias("parity"))


def _voices_read(s: SparkSession, d: str) -> DataFrame:
    path = new_folder(s, "voices")
    rows = _voices(s, d).select("voice_id", "voice_name", "ref_audio_path", F.create_map(F.lit("seq"), F.col("seq").cast("string")).alias("metadata"))
    rows.write.json(path)
    return S.read_voices(s, path, per_line=True).select("voice_id", "voice_name", "ref_audio_path", F.col("metadata")["seq"].alias("seq"))


def _folder_progress(s: SparkSession, d: str) -> DataFrame:
    """Progress from files that were written; their times are left out, as they are those of this run."""
    path, of = new_folder(s, "finished"), D.written_dialogues(s, d)
    _write_segments(D.files(s, d, of).where("length > 0"), path, F.lit("x"))
    totals = of.groupBy("book_id").agg(F.count("*").alias("total"))
    return jobs.folder_progress(s, path, totals, NUMBER, BOOK).select("book_id", "done", "total", "remaining", "percent")


def _folder_changes(s: SparkSession, d: str) -> DataFrame:
    """The differences of three listings: after the even segments, after the odd ones, and without any news."""
    path, manifest = new_folder(s, "live"), new_folder(s, "manifest")
    files, found = D.files(s, d, D.written_dialogues(s, d)).where("length > 0"), []
    for part in ("ord % 2 = 0", "ord % 2 = 1", "false"):
        _write_segments(files.where(part), path, F.lit("x"))
        found.append(listing.list_changes(s, path, manifest, NUMBER).withColumn("round", F.lit(len(found) + 1)))
    book = F.regexp_extract("path", BOOK, 1).cast("long")
    return found[0].union(found[1]).union(found[2]).select(book.alias("book_id"), "ord", "round", "gone")


def _casting(s: SparkSession, d: str) -> DataFrame:
    """Speakers with the audio of either table of the configuration."""
    cast, default = S.casting_tables(s, D.CAST)
    people = casting.join_gender(D.dialogues(s, d), D.genders(s)).select("book_id", "speaker", "gender").distinct()
    own = people.join(F.broadcast(cast), "speaker").select("book_id", "speaker", F.lit("speaker").alias("by"), "ref_audio")
    return own.union(people.join(F.broadcast(default), "gender").select("book_id", "speaker", F.lit("gender").alias("by"), "ref_audio"))


def _preset_casting(s: SparkSession, d: str) -> DataFrame:
    """A configuration without the narrator and without a male default."""
    cast, default = S.casting_tables(s, {"characters": {"assistant": "a.wav"}, "default_audio": {"female": "f.wav"}})
    return casting.cast_voice(casting.join_gender(D.dialogues(s, d), D.genders(s)), cast, default).select("book_id", "ord", "speaker", "ref_audio")


def _book_genders(s: SparkSession, d: str) -> DataFrame:
    """Verdicts by book, with a second and weaker one on each speaker."""
    sure = _genders_read(s, d).withColumn("gender", F.when(F.col("book_id") % 2 == 0, F.col("gender")).otherwise("female"))
    return sure.union(sure.select("book_id", "speaker", F.lit("male").alias("gender"), F.lit(0.1).alias("confidence")))


def _voice_rows(s: SparkSession, d: str) -> DataFrame:
    return D.dialogues(s, d).where("speaker <> ''").select(F.concat_ws("-", "book_id", "speaker").alias("voice_id"), F.col("speaker").alias("voice_name"), T.segment_path(F.col("ord")).alias("ref_audio_path"), F.col("ord").alias("seq"))


def _voices(s: SparkSession, d: str) -> DataFrame:
    v = _voice_rows(s, d)
    return S.upsert_voices(v.where("seq % 2 = 0"), v.where("seq % 2 = 1"))


def _bracketed(s: SparkSession, d: str) -> DataFrame:
    rows = D.dialogues(s, d).select("book_id", "line_no", F.concat(F.lit("【"), "speaker", F.lit("|alias】「"), "text", F.lit("」")).alias("line"))
    return S.bracket_labels(rows)


def _words_table(s: SparkSession, d: str) -> DataFrame:
    """Keywords as a table: first words of some lines, and fixed ones, of one and two characters too."""
    fixed = s.createDataFrame([("the",), ("there",), ("ent",), ("é",), ("k",), ("ll",), ("nowhere to be found",)], "keyword string")
    first = D.document_lines(s, d).where("book_id % 7 = 0").select(F.substring_index("line", " ", 1).alias("keyword")).where("length(keyword) > 2")
    return fixed.union(first)


WORDS_SQL = """, k AS (
  SELECT unnest(['the', 'there', 'ent', 'é', 'k', 'll', 'nowhere to be found']) AS keyword
  UNION SELECT split_part(line, ' ', 1) FROM doc_lines WHERE book_id % 7 = 0 AND length(split_part(line, ' ', 1)) > 2
)"""


def _calls(s: SparkSession, d: str) -> DataFrame:
    """Tool calls made of the lines: each kind, with and without arguments, and broken ones."""
    rows = D.lines(s, d)
    kind = F.element_at(F.array(*map(F.lit, ["search_novel", "read_lines", "get_dialogues", "fly"])), (F.col("line_no") % 4 + 1).cast("int"))
    word = F.translate(F.substring("line", 3, 2), '"\\', "")
    arguments = (
        F.when(F.col("line_no") % 5 == 0, "{}").when(F.col("line_no") % 11 == 1, "{broken")
        .when(kind == "read_lines", F.format_string('{"start_line": %d, "end_line": "%d"}', F.col("line_no") - 3, F.col("line_no") + 2))
        .otherwise(F.format_string('{"keyword": "%s", "character_name": "%s", "limit": %d}', word, word, F.col("line_no") % 3))
    )
    return rows.select("book_id", F.col("line_no").alias("call_id"), kind.alias("name"), arguments.alias("arguments"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    return keywords.answer_calls(_calls(s, d), D.lines(s, d))



def _asked(s: SparkSession, df: DataFrame, words: list[str]) -> DataFrame:
    return df.select("book_id").distinct().withColumn("keyword", F.explode(F.array(*map(F.lit, words))))


def _searched(s: SparkSession, d: str) -> DataFrame:
    return context.keyword_search(D.document_lines(s, d), D.KEYWORDS)


def _ranges(s: SparkSession, d: str) -> DataFrame:
    docs = D.document_lines(s, d)
    end = F.when(F.col("book_id") % 5 == 0, 1).when(F.col("book_id") % 5 == 1, 2).otherwise(400)
    asked = docs.select("book_id").distinct().select("book_id", (F.col("book_id") % 3 * 2 - 1).cast("long").alias("start"), end.cast("long").alias("end"))
    nowhere = s.createDataFrame([(-7, 1, 10)], "book_id long, start long, end long")
    return context.read_range(docs, asked.union(nowhere))


def _mentions(s: SparkSession, d: str) -> DataFrame:
    return context.mention_dialogues(D.lines(s, d), ["user", "assistant"])


def _mentions_shown(s: SparkSession, d: str) -> DataFrame:
    return context.mention_dialogues(D.lines(s, d), ["user", "assistant"], limit=20)


def _contexts(s: SparkSession, d: str) -> DataFrame:
    return context.context_window(D.dialogues(s, d), D.lines(s, d))


def _model() -> Callable[[str], str]:
    """A deterministic model for checks: answers by the length of the request, now and then it fails."""

    def answer(request: str) -> str:
        n = len(request)
        if n % 11 == 0:
            raise ValueError("no answer")
        return 'Sure: {"emotion": "%s", "tone": "%s", "confidence": 0.5, "evidence": "n=%d"} done' % (T.EMOTIONS[n % 7], T.TONES[n % 5], n)

    return answer


def _replies(s: SparkSession, d: str) -> DataFrame:
    return labeling.apply_model(D.dialogues(s, d).select("book_id", "ord", F.col("text").alias("request")), _model)


def _batch_model() -> Callable[[list[str]], list]:
    one = _model()

    def answer(requests: list[str]) -> list:
        out = []
        for r in requests:
            try:
                out.append(one(r))
            except ValueError as e:
                out.append(e)
        return out

    return answer


def _batched_replies(s: SparkSession, d: str) -> DataFrame:
    return labeling.apply_model(D.dialogues(s, d).select("book_id", "ord", F.col("text").alias("request")), _batch_model, batched=True)


def _tagged_model(tag: str) -> Callable:
    """A model that says which run it was asked in."""
    return lambda: lambda request: f"{tag}:{len(request)}"


def _resumed(s: SparkSession, d: str) -> DataFrame:
    """Four runs over one store: a half of the requests, all, all with some texts changed, and some with force."""
    store, keys = new_folder(s, "answers"), ["book_id", "ord"]
    asked = D.dialogues(s, d).select("book_id", "ord", F.col("text").alias("request"))
    labeling.label_resumably(asked.where("ord % 2 = 0"), _tagged_model("one"), store, keys)
    labeling.label_resumably(asked, _tagged_model("two"), store, keys)
    changed = asked.withColumn("request", F.when(F.col("ord") % 5 == 0, F.concat("request", F.lit("!"))).otherwise(F.col("request")))
    third = labeling.label_resumably(changed, _tagged_model("three"), store, keys).withColumn("step", F.lit(3))
    path = new_folder(s, "third")
    third.write.parquet(path)  # before a new generation hides it
    forced = labeling.label_resumably(changed.where("ord % 3 = 0"), _tagged_model("four"), store, keys, force=True)
    return s.read.parquet(path).union(forced.withColumn("step", F.lit(4)))


def _labelled_genders(s: SparkSession, d: str) -> DataFrame:
    return jobs.label_genders(D.dialogues(s, d), _gender_model, new_folder(s, "answers"))


def _gender_model() -> Callable[[str], str]:
    def answer(request: str) -> str:
        name = request.split("\n")[0].removeprefix("Character: ")
        if name == "guest":
            raise ValueError("no answer")
        return '{"character_name": "%s", "gender": "%s", "confidence": 0.8, "evidence": "%d"}' % (name, "female" if name == "user" else "unknown", len(request))

    return answer


def _gender_replies(s: SparkSession, d: str) -> DataFrame:
    m = F.length("text") % 3
    body = F.when(m == 0, F.concat(F.lit('I think {"character_name": "'), "speaker", F.lit('", "gender": "unknown", "confidence": 0.2} so'))).when(m == 1, F.concat(F.lit('{"character_name": "'), "speaker", F.lit('", "gender": "female", "confidence": 0.9, "evidence": "e"}'))).otherwise(F.lit("no idea"))
    return labeling.parse_gender_reply(D.dialogues(s, d).select("book_id", "ord", "speaker", body.alias("reply")))


def _samples(s: SparkSession, d: str) -> DataFrame:
    return audio.frame_rms(D.frames(s, d).select("clip_id", F.col("frame_idx").alias("sample_idx"), F.col("rms").alias("v")), 16, 4).withColumn("rms", F.round("rms", 4))


def _regions(s: SparkSession, d: str) -> DataFrame:
    return audio.voiced_regions(D.frames(s, d), 40.0)


def _totals(s: SparkSession, d: str) -> DataFrame:
    return D.frames(s, d).groupBy("clip_id").agg((F.count("*") * 100).alias("total_ms"))


def _timeline(s: SparkSession, d: str) -> DataFrame:
    return timeline.splice_timeline(D.segments(s, d))


#: More than the lines of a book, the frames of a clip and the labels of a table.
GAP = 1_000_000


def _one_book(s: SparkSession, d: str) -> DataFrame:
    """All books as one, its places with large gaps between them; labels repeat the five of each book."""
    place = F.col("book_id") * GAP
    rows = D.lines(s, d).select(F.lit(0).cast("long").alias("book_id"), (place + F.col("line_no")).alias("line_no"), "line")
    names = F.array(*map(F.lit, ["user", "assistant", T.NARRATOR, T.NON_PERSON, "guest"]))
    named = s.range(GAP).select(F.lit(0).cast("long").alias("book_id"), F.col("id").alias("ord"), F.element_at(names, (F.col("id") % 5 + 1).cast("int")).alias("label"))
    return parsing.dialogue_table(rows, named)


def _synthesis(s: SparkSession, d: str) -> DataFrame:
    of = D.written_dialogues(s, d)
    return jobs.synthesis_jobs(of, D.genders(s), D.emotions(s, d, of), *S.casting_tables(s, D.CAST), D.files(s, d, of))


def _presets(s: SparkSession, d: str) -> DataFrame:
    of = D.written_dialogues(s, d)
    return jobs.preset_jobs(of, D.genders(s), D.clones(s), D.audio_files(s), D.files(s, d, of))


def _volume(s: SparkSession, d: str) -> list[DataFrame]:
    of = D.written_dialogues(s, d)
    return [of, D.files(s, d, of), D.segments(s, d, of), D.results(s, d, of)]


def _one_timeline(s: SparkSession, d: str) -> DataFrame:
    rows = D.segments(s, d).select(F.lit(0).cast("long").alias("book_id"), (F.col("book_id") * GAP + F.col("ord")).alias("ord"), "chapter", "duration_ms")
    return timeline.splice_timeline(rows).drop("book_id")


def _one_clip(s: SparkSession, d: str) -> DataFrame:
    frames = D.frames(s, d).select(F.lit(0).cast("long").alias("clip_id"), (F.col("clip_id") * GAP + F.col("frame_idx")).alias("frame_idx"), "rms")
    return audio.clip_plan(audio.merge_regions(audio.voiced_regions(frames, 40.0)), cap=10**15)


def _register() -> None:
    all_d = "SELECT book_id, ord, line_no, chapter, text, speaker FROM dialogues"
    # sources and sinks
    _op("read_lines", _written_lines, "SELECT book_id, line_no, line FROM lines")
    _op("read_speaker_labels", _written_labels, "SELECT book_id, ord, label FROM labels")
    _op("read_gender_results", _genders_read, "SELECT book_id, speaker, gender, confidence FROM (SELECT DISTINCT book_id, speaker FROM dialogues) JOIN genders USING (speaker)")
    _op("read_emotion_results", _emotion_files, "SELECT book_id, ord, emotion, tone, confidence, evidence FROM emotions")
    _op("casting_tables", _casting, "SELECT DISTINCT book_id, speaker, 'speaker' AS by, ref AS ref_audio FROM gendered JOIN cast_map ON who = speaker UNION ALL SELECT DISTINCT book_id, speaker, 'gender', CASE gender WHEN 'female' THEN 'f.wav' ELSE 'm.wav' END FROM gendered")
    _op("scan_segment_files", _segment_files, "SELECT book_id, ord, length % 7 + 2 AS length FROM files")
    _op("write_labels_json", _label_file, f"SELECT book_id, total, success, fail, '{' '.join(T.EMOTIONS)}' AS emotions, '{' '.join(T.TONES)}' AS tones, ord, emotion, tone, confidence, evidence FROM emotions JOIN (SELECT book_id, count(*) AS total, count(*) FILTER (NOT starts_with(evidence, 'Error:')) AS success, count(*) FILTER (starts_with(evidence, 'Error:')) AS fail FROM emotions GROUP BY book_id) USING (book_id)")
    _op("write_segments", _segments_back, "SELECT book_id, ord, chapter, speaker, printf('%05d_%s.wav', ord, speaker) AS audio_path FROM dialogues")
    _op("debug_listing", lambda s, d: S.debug_listing(D.dialogues(s, d), 3, 12), """, x AS (SELECT * FROM dialogues WHERE ord >= 3 AND ord < 12), b AS (SELECT book_id, count(*) AS n, count(DISTINCT speaker) FILTER (speaker <> '') AS people FROM x GROUP BY book_id)
SELECT book_id, 0::BIGINT AS row, '对话范围: 3-12' AS listing FROM b UNION ALL SELECT book_id, 1, '共 ' || n || ' 条对话, ' || people || ' 个角色' FROM b
UNION ALL SELECT book_id, 2, repeat('=', 60) FROM b UNION ALL SELECT book_id, 3, '' FROM b UNION ALL SELECT book_id, ord + 4, '[' || ord || '] ' || speaker || ': ' || text FROM x""")
    _op("to_tables", _tables_back, f""", p AS (SELECT book_id, row_number() OVER (ORDER BY book_id) AS id FROM (SELECT DISTINCT book_id FROM dialogues)
), c AS (
  SELECT p.id AS project_id, book_id, speaker, n, row_number() OVER (ORDER BY p.id, speaker) AS id,
    CASE WHEN g.gender IS NULL THEN 'unknown' WHEN book_id % 2 = 0 THEN g.gender ELSE 'female' END AS gender, CASE WHEN g.gender = 'female' THEN 'f.wav' ELSE 'm.wav' END AS usual
  FROM (SELECT book_id, speaker, count(*) AS n FROM dialogues WHERE speaker <> '' GROUP BY ALL) JOIN p USING (book_id) LEFT JOIN genders g USING (speaker)
)
SELECT 'projects' AS "table", id, 'book ' || book_id || '|' || CASE WHEN book_id % 2 = 0 THEN 'done' ELSE 'parsed' END || '|2024-02-29 12:30:00' AS row FROM p
UNION ALL SELECT 'characters', id, speaker || '|' || gender || '|' || n || '|' || project_id FROM c
UNION ALL SELECT 'dialogues', row_number() OVER (ORDER BY p.id, ord), chapter || '|' || text || '|' || speaker || '|' || ord || '|' || p.id FROM dialogues JOIN p USING (book_id)
UNION ALL SELECT 'audio_files', row_number() OVER (ORDER BY id), coalesce(ref, usual) || '|' || CASE WHEN ref IS NULL THEN 'preset' ELSE 'upload' END || '|' || id || '|2024-02-29 12:30:00' FROM c LEFT JOIN cast_map ON who = speaker""")
    _op("voice_registry", _registry, "SELECT book_id || '-' || speaker AS voice_id, speaker AS voice_name, printf('%05d.wav', o) AS ref_audio_path, o::VARCHAR AS seq, (o % 2)::VARCHAR AS parity FROM (SELECT book_id, speaker, coalesce(max(ord) FILTER (ord % 2 = 1), max(ord)) AS o FROM dialogues WHERE speaker <> '' GROUP BY book_id, speaker)")
    _op("folder_progress", _folder_progress, "SELECT book_id, done, total, total - done AS remaining, round(100.0::DOUBLE * done / total, 4) AS percent FROM (SELECT book_id, count(*) AS done FROM files WHERE length > 0 GROUP BY book_id) JOIN (SELECT book_id, count(*) AS total FROM dialogues GROUP BY book_id) USING (book_id)")
    _op("folder_changes", _folder_changes, "SELECT book_id, ord, CASE WHEN ord % 2 = 0 THEN 1 ELSE 2 END AS round, false AS gone FROM files WHERE length > 0")
    _op("upsert_voice", _voices, "SELECT book_id || '-' || speaker AS voice_id, speaker AS voice_name, printf('%05d.wav', max(ord)) AS ref_audio_path, max(ord) AS seq FROM dialogues WHERE speaker <> '' GROUP BY book_id, speaker")
    _op("read_voices", _voices_read, "SELECT book_id || '-' || speaker AS voice_id, speaker AS voice_name, printf('%05d.wav', max(ord)) AS ref_audio_path, max(ord)::VARCHAR AS seq FROM dialogues WHERE speaker <> '' GROUP BY book_id, speaker")
    _op("extract_bracket_labels", _bracketed, "SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY line_no) - 1 AS ord, speaker AS label FROM dialogues")
    # projections and filters
    _op("classify_lines", lambda s, d: parsing.classify_lines(D.lines(s, d)), "SELECT book_id, line_no, kind, text, speaker FROM parsed")
    _op("is_chapter", lambda s, d: D.lines(s, d).select("book_id", "line_no", T.is_chapter(T.strip(F.col("line"))).alias("is_chapter")), f"SELECT book_id, line_no, regexp_matches(s, '(?i){T.CHAPTER}') AS is_chapter FROM stripped")
    _op("keep_narration", lambda s, d: parsing.keep_narration(D.parsed(s, d)).select("book_id", "line_no", "kind", "text", "speaker"), f"SELECT book_id, line_no, kind, text, CASE WHEN kind='narrative' THEN '{T.NARRATOR}' ELSE speaker END AS speaker FROM parsed WHERE kind='dialogue' OR (kind='narrative' AND length(text) > 5)")
    _op("normalize_label", lambda s, d: D.labels(s, d).select("book_id", "ord", parsing.normalize_label(F.col("label")).alias("label")), f"SELECT book_id, ord, CASE WHEN label = '{T.NON_PERSON}' THEN '' ELSE label END AS label FROM labels")
    _op("needs_emotion", lambda s, d: stats.needs_emotion(D.dialogues(s, d)), f"{all_d} WHERE speaker NOT IN ('', '{T.NARRATOR}')")
    _op("slice_dialogues", lambda s, d: stats.slice_dialogues(D.dialogues(s, d), between=[2, 9]), f"{all_d} WHERE ord >= 2 AND ord < 9")
    _op("style_prefix", lambda s, d: D.emotions(s, d).select("book_id", "ord", T.style_prefix(F.col("emotion"), F.col("tone")).alias("style")), f"SELECT book_id, ord, '(' || concat_ws('，', {_phrases(T.EMOTION_PHRASES)}[emotion], {_phrases(T.TONE_PHRASES)}[tone]) || ')' AS style FROM emotions")
    _op("synthesis_text", lambda s, d: D.dialogues(s, d).select("book_id", "ord", T.synthesis_text(F.lit("(x)\n"), F.concat(F.lit('"'), "text"), True).alias("text")), """SELECT book_id, ord, '(x) \\"' || replace(replace(text, chr(10), ' '), '"', '\\"') AS text FROM dialogues""")
    _op("segment_path", lambda s, d: D.dialogues(s, d).select("book_id", "ord", T.segment_path(F.col("ord")).alias("path"), T.segment_path(F.col("ord"), F.col("speaker")).alias("named")), "SELECT book_id, ord, printf('%05d.wav', ord) AS path, printf('%05d_%s.wav', ord, speaker) AS named FROM dialogues")
    _op("confidence_flag", lambda s, d: _genders_of(s, d).select("book_id", "speaker", T.confidence_flag(F.col("confidence") - 0.3).alias("flag")), "SELECT DISTINCT book_id, speaker, CASE WHEN confidence - 0.3 > 0.5 THEN '✓' ELSE '?' END AS flag FROM dialogues JOIN genders USING (speaker)")
    _op("format_duration", lambda s, d: D.segments(s, d).select("book_id", "ord", T.format_duration(F.col("duration_ms") / 97).alias("shown")), "SELECT book_id, ord, CASE WHEN x < 60 THEN printf('%.1fs', x) WHEN x < 3600 THEN printf('%.1fmin', x / 60) ELSE printf('%.1fh', x / 3600) END AS shown FROM (SELECT *, duration_ms / 97 AS x FROM segments)")
    _op("preview", lambda s, d: D.dialogues(s, d).select("book_id", "ord", T.preview(F.col("text"), 30).alias("preview")), "SELECT book_id, ord, substr(text, 1, 30) AS preview FROM dialogues")
    _op("voice_gender", lambda s, d: D.lines(s, d).select("book_id", "line_no", T.voice_gender(F.concat(F.element_at(F.array(*map(F.lit, ["FeMale ", "Microsoft ZIRA ", "male ", "David "])), (F.col("line_no") % 4 + 1).cast("int")), "line")).alias("gender")), "SELECT book_id, line_no, CASE WHEN line_no % 4 < 2 OR contains(lower(line), 'female') OR contains(lower(line), 'zira') THEN 'female' ELSE 'male' END AS gender FROM lines")
    # joins
    _op("align_labels", lambda s, d: parsing.align_labels(D.parsed(s, d), D.labels(s, d)).select("book_id", "line_no", "kind", "text", "chapter", "speaker"), "SELECT * FROM aligned")
    _op("align_quotes", lambda s, d: parsing.align_quotes(D.lines(s, d), D.labels(s, d)), f"SELECT q.book_id, k, line_no, text, CASE WHEN label IS NULL OR label = '{T.NON_PERSON}' THEN '' ELSE label END AS speaker FROM quotes q LEFT JOIN labels l ON l.book_id = q.book_id AND l.ord = k")
    _op("join_gender", lambda s, d: casting.join_gender(D.dialogues(s, d), D.genders(s)).select("book_id", "ord", "speaker", "gender"), "SELECT book_id, ord, speaker, gender FROM gendered")
    _op("join_gender_by_book", lambda s, d: casting.join_gender(D.dialogues(s, d), _book_genders(s, d)).select("book_id", "ord", "speaker", "gender"), "SELECT book_id, ord, speaker, CASE WHEN g.gender IS NULL THEN 'male' WHEN book_id % 2 = 0 THEN g.gender ELSE 'female' END AS gender FROM dialogues LEFT JOIN genders g USING (speaker)")
    _op("cast_voice_presets", _preset_casting, f"SELECT book_id, ord, speaker, CASE WHEN speaker IN ('', '{T.NARRATOR}') THEN 'narrator.wav' WHEN speaker='assistant' THEN 'a.wav' WHEN gender='female' THEN 'f.wav' ELSE 'male.wav' END AS ref_audio FROM gendered")
    _op("cast_voice", lambda s, d: casting.cast_voice(casting.join_gender(D.dialogues(s, d), D.genders(s)), *S.casting_tables(s, D.CAST)).select("book_id", "ord", "speaker", "ref_audio"), "SELECT book_id, ord, speaker, ref_audio FROM voiced")
    _op("assign_engine", lambda s, d: casting.assign_engine(casting.join_gender(D.dialogues(s, d), D.genders(s)), D.clones(s), D.audio_files(s), D.genders(s)).select("book_id", "ord", "engine", "voice"), "SELECT book_id, ord, CASE WHEN speaker='assistant' THEN 'clone' ELSE 'preset' END AS engine, CASE WHEN speaker='assistant' THEN 'a.wav' WHEN speaker='user' THEN 'female_voice' ELSE 'male_voice' END AS voice FROM dialogues")
    _op("join_emotion", lambda s, d: casting.join_emotion(D.dialogues(s, d), D.emotions(s, d)).select("book_id", "ord", "emotion", "tone"), "SELECT book_id, ord, emotion, tone FROM moods")
    _op("pending_jobs", lambda s, d: casting.pending_jobs(D.dialogues(s, d), D.files(s, d)).select("book_id", "ord"), "SELECT book_id, ord FROM dialogues WHERE NOT (ord%3=0 AND ord%9<>0)")
    _op("context_window", _contexts, "SELECT * FROM ctx")
    _op("keyword_search", _searched, "SELECT keyword, book_id, line_no, line, total, total > 20 AS truncated FROM found WHERE rn <= 20")
    _op("read_range", _ranges, "SELECT * FROM ranges")
    _op("mention_dialogues", _mentions, "SELECT keyword, book_id, line_no, line, total, total > 50 AS truncated FROM mentions WHERE rn <= 50")
    _op("missing_quotes", lambda s, d: parsing.missing_quotes(D.lines(s, d), D.parsed(s, d)), f"SELECT book_id, k, line_no, regexp_replace(q.text, {_STRIP}) AS text, substr(l.line, 1, 100) AS line, pp.kind AS kind FROM quotes q JOIN lines l USING (book_id, line_no) JOIN (SELECT book_id, line_no, kind FROM parsed) pp USING (book_id, line_no) WHERE NOT EXISTS (SELECT 1 FROM parsed p WHERE kind='dialogue' AND p.book_id = q.book_id AND p.text = regexp_replace(q.text, {_STRIP}))")
    _op("reconcile_results", lambda s, d: casting.reconcile_results(D.segments(s, d).select("book_id", "ord").withColumn("engine", F.lit("clone")), D.results(s, d)), "SELECT s.book_id, s.ord, CASE WHEN status='ok' THEN 'clone' ELSE 'fallback' END AS engine, coalesce(status,'missing') AS status, CASE WHEN status='ok' THEN 0 ELSE 1000 END::BIGINT AS placeholder_ms FROM segments s LEFT JOIN results r USING (book_id, ord)")
    _op("all_segments", lambda s, d: timeline.all_segments(D.dialogues(s, d), D.files(s, d)), "SELECT book_id, ord, chapter, speaker, printf('%05d.wav', ord) AS audio_path, (ord%3=0 AND ord%9<>0) AS readable FROM dialogues")
    _op("locate_text", lambda s, d: context.locate_text(D.dialogues(s, d), D.KEYWORDS), """, h AS (SELECT keyword AS needle, book_id, min(ord) AS hit FROM dialogues JOIN words ON contains(text, keyword) GROUP BY ALL)
SELECT needle, d.book_id, ord, speaker, text, ord = hit AS is_hit FROM h JOIN dialogues d ON d.book_id = h.book_id AND ord BETWEEN hit - 3 AND hit + 3""")
    _op("keyword_table_search", lambda s, d: keywords.search_table(D.document_lines(s, d), _words_table(s, d)), WORDS_SQL + f""", hit AS (
  SELECT keyword, book_id, line_no, substr(regexp_replace(line, {_STRIP}), 1, 120) AS line, count(*) OVER (PARTITION BY keyword, book_id) AS total, row_number() OVER (PARTITION BY keyword, book_id ORDER BY line_no) AS rn
  FROM doc_lines JOIN k ON contains(line, keyword)
) SELECT keyword, book_id, line_no, line, total, total > 20 AS truncated FROM hit WHERE rn <= 20""")
    _op("mention_table", lambda s, d: keywords.mention_table(D.lines(s, d), s.createDataFrame([("user",), ("assistant",)], "keyword string")), "SELECT keyword, book_id, line_no, line, total, total > 50 AS truncated FROM mentions WHERE rn <= 50")
    _op("locate_table", lambda s, d: keywords.locate_table(D.written_dialogues(s, d), _words_table(s, d)), WORDS_SQL + """, h AS (SELECT keyword AS needle, book_id, min(ord) AS hit FROM dialogues JOIN k ON contains(text, keyword) GROUP BY ALL)
SELECT needle, d.book_id, ord, speaker, text, ord = hit AS is_hit FROM h JOIN dialogues d ON d.book_id = h.book_id AND ord BETWEEN hit - 3 AND hit + 3""")
    _op("answer_calls", _answers, """, c AS (
  SELECT book_id, line_no AS call_id, ['search_novel', 'read_lines', 'get_dialogues', 'fly'][(line_no % 4 + 1)::INT] AS name, line_no % 5 = 0 OR line_no % 11 = 1 AS bare, translate(substr(line, 3, 2), chr(34) || chr(92), '') AS word FROM lines
), a AS (
  SELECT *, CASE WHEN bare THEN '' ELSE word END AS keyword, CASE WHEN bare THEN 20 ELSE greatest(call_id % 3, 1) END AS lim,
    CASE WHEN bare THEN 1 ELSE greatest(call_id - 3, 1) END AS lo, CASE WHEN bare THEN 101 ELSE call_id + 2 END AS hi FROM c
), w AS (
  SELECT a.book_id, call_id, name, lim, l.line_no, substr(l.s, 1, 120) AS line, count(*) OVER (PARTITION BY a.book_id, call_id) AS total, row_number() OVER (PARTITION BY a.book_id, call_id ORDER BY l.line_no) AS rn
  FROM a JOIN stripped l ON l.book_id = a.book_id AND CASE name WHEN 'search_novel' THEN contains(l.line, keyword) WHEN 'get_dialogues' THEN contains(l.s, keyword) AND contains(l.s, '「') ELSE false END
), g AS (SELECT book_id, call_id, string_agg('Line ' || line_no || ': ' || line, chr(10) ORDER BY line_no) AS body, count(*) AS shown, max(total) AS total FROM w WHERE rn <= lim GROUP BY ALL
), r AS (SELECT a.book_id, call_id, string_agg(l.line_no || ': ' || s, chr(10) ORDER BY l.line_no) AS body FROM a JOIN stripped l ON l.book_id = a.book_id AND l.line_no BETWEEN lo AND hi WHERE name = 'read_lines' GROUP BY ALL
) SELECT a.book_id, a.call_id, CASE name
  WHEN 'search_novel' THEN 'Found ' || coalesce(total, 0) || ' matches' || CASE WHEN total > shown THEN ' (showing ' || shown || ' of ' || total || ')' ELSE '' END || coalesce(':' || chr(10) || g.body, chr(10) || 'No matches found')
  WHEN 'get_dialogues' THEN coalesce('Found ' || shown || ' dialogues:' || chr(10) || g.body, 'No dialogues found for ''' || keyword || '''')
  WHEN 'read_lines' THEN coalesce(r.body, 'No lines in range') ELSE 'Unknown tool: fly' END AS output
FROM a LEFT JOIN g ON g.book_id = a.book_id AND g.call_id = a.call_id LEFT JOIN r ON r.book_id = a.book_id AND r.call_id = a.call_id""")
    # aggregations
    _op("speaker_counts", lambda s, d: stats.speaker_counts(D.dialogues(s, d)), "SELECT * FROM speakers")
    _op("top_speakers", lambda s, d: stats.top_speakers(D.dialogues(s, d), 3), "SELECT * FROM ranked WHERE rank <= 3")
    _op("kind_counts", lambda s, d: stats.kind_counts(D.parsed(s, d)), "SELECT kind, count(*) AS n FROM parsed GROUP BY kind")
    _op("distinct_speakers", lambda s, d: stats.distinct_speakers(D.dialogues(s, d)), "SELECT DISTINCT book_id, speaker FROM dialogues WHERE speaker <> ''")
    _op("character_corpus", lambda s, d: context.character_corpus(D.dialogues(s, d)), "SELECT * FROM corpus")
    _op("label_summary", lambda s, d: stats.label_summary(D.emotions(s, d)), "SELECT book_id, count(*) AS total, count(*) FILTER (NOT starts_with(evidence, 'Error:')) AS success, count(*) FILTER (starts_with(evidence, 'Error:')) AS fail FROM emotions GROUP BY book_id")
    _op("time_per_item", lambda s, d: stats.time_per_item(D.run_log(s, d)), "SELECT engine, count(*) AS n, round(avg(seconds), 4) AS avg_seconds FROM run_log GROUP BY engine")
    _op("progress_report", lambda s, d: stats.progress_report(D.files(s, d), D.dialogues(s, d).groupBy("book_id").agg(F.count("*").alias("total")), now=1_700_500_000), """, f AS (SELECT book_id, count(*) AS done, arg_min(modified_s, ord) AS t0, arg_max(modified_s, ord) AS t1 FROM files GROUP BY book_id), t AS (SELECT book_id, count(*) AS total FROM dialogues GROUP BY book_id),
p AS (SELECT *, t1 - t0 AS elapsed_s, (t1 - t0) / done AS a, (t1 - t0) / done * (total - done) AS e FROM f JOIN t USING (book_id))
SELECT book_id, done, total, total - done AS remaining, round(100.0::DOUBLE * done / total, 4) AS percent, elapsed_s, round(a, 4) AS avg_s, round(e, 4) AS eta_s, strftime(make_timestamp(t0 * 1000000), '%H:%M:%S') AS first_clock,
  strftime(make_timestamp(t1 * 1000000), '%H:%M:%S') AS last_clock, strftime(make_timestamp(floor(1700500000 + e)::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') AS estimated_end FROM p""")
    _op("chapter_manifest", lambda s, d: timeline.chapter_manifest(D.segments(s, d)), "SELECT book_id, file_index, CASE WHEN chapter='' THEN 'chapter_' || file_index ELSE chapter END AS title, segments, duration_ms FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY f) AS file_index FROM (SELECT book_id, chapter, min(ord) AS f, count(*) AS segments, sum(duration_ms)::BIGINT AS duration_ms FROM segments GROUP BY ALL))")
    _op("volume_stats", lambda s, d: timeline.volume_stats(D.files(s, d), _timeline(s, d)), "SELECT book_id, duration_ms, size_mb FROM (SELECT book_id, max(end_ms) AS duration_ms FROM timeline GROUP BY book_id) LEFT JOIN (SELECT book_id, round(sum(length) / 1048576, 4) AS size_mb FROM files GROUP BY book_id) USING (book_id)")
    _op("speech_stats", lambda s, d: audio.speech_stats(audio.merge_regions(_regions(s, d)), _totals(s, d)), "SELECT clip_id, coalesce(n, 0) AS regions, coalesce(sp, 0) AS speech_ms, total_ms - coalesce(sp, 0) AS silence_ms, round(coalesce(sp, 0) / total_ms, 4) AS ratio FROM (SELECT clip_id, count(*) * 100 AS total_ms FROM frames GROUP BY ALL) LEFT JOIN (SELECT clip_id, count(*) AS n, sum(end_ms - start_ms)::BIGINT AS sp FROM joined GROUP BY ALL) USING (clip_id)")
    _op("longest_region", lambda s, d: audio.longest_region(_regions(s, d)), "SELECT clip_id, start_ms, end_ms FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY end_ms - start_ms DESC, start_ms) AS rn FROM regions) WHERE rn = 1")
    _op("extraction_report", lambda s, d: parsing.extraction_report(D.lines(s, d), D.parsed(s, d)), f""", m AS (SELECT book_id, count(*) AS missing FROM quotes q WHERE NOT EXISTS (SELECT 1 FROM parsed p WHERE kind='dialogue' AND p.book_id = q.book_id AND p.text = regexp_replace(q.text, {_STRIP})) GROUP BY book_id)
SELECT book_id, coalesce(n, 0) AS quotes, dialogues, coalesce(missing, 0) AS missing FROM (SELECT book_id, count(*) FILTER (kind='dialogue') AS dialogues FROM parsed GROUP BY book_id) LEFT JOIN (SELECT book_id, count(*) AS n FROM quotes GROUP BY book_id) USING (book_id) LEFT JOIN m USING (book_id)""")
    # windows
    _op("fill_chapter", lambda s, d: D.parsed(s, d), "SELECT * FROM filled")
    _op("splice_timeline", _timeline, "SELECT *, end_ms - duration_ms AS start_ms FROM timeline")
    _op("fade_plan", lambda s, d: timeline.fade_plan(D.segments(s, d)).select("book_id", "ord", "fade_ms"), "SELECT book_id, ord, CASE WHEN duration_ms >= 100 THEN 50 ELSE 0 END::BIGINT AS fade_ms FROM segments")
    _op("first_cooccurrence", lambda s, d: stats.first_cooccurrence(D.dialogues(s, d), "user", "guest"), "SELECT book_id, min(ord) AS ord FROM (SELECT book_id, ord, max((speaker='user')::INT) OVER w AS a, max((speaker='guest')::INT) OVER w AS b, count(*) OVER (PARTITION BY book_id) AS n FROM dialogues WINDOW w AS (PARTITION BY book_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) WHERE a + b = 2 AND ord < n - 10 GROUP BY book_id")
    _op("first_line_context", lambda s, d: stats.first_line_context(D.dialogues(s, d), "guest"), "SELECT book_id, ord, speaker, text, ord = hit AS is_hit FROM dialogues JOIN (SELECT book_id, min(ord) AS hit FROM dialogues WHERE speaker='guest' GROUP BY book_id) USING (book_id) WHERE ord BETWEEN hit - 3 AND hit + 7")
    _op("frame_rms", _samples, """, p AS (SELECT clip_id, frame_idx // 4 AS h, sum(rms * rms) AS e FROM frames GROUP BY ALL), g AS (SELECT clip_id, unnest(range((max(frame_idx) + 1) // 4 + 1)) AS h FROM frames GROUP BY clip_id)
SELECT clip_id, h AS frame_idx, round(sqrt(sum(coalesce(e, 0)) OVER (PARTITION BY clip_id ORDER BY h ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 16), 4) AS rms FROM g LEFT JOIN p USING (clip_id, h)""")
    _op("voiced_regions", _regions, "SELECT * FROM regions")
    _op("merge_regions", lambda s, d: audio.merge_regions(_regions(s, d)), "SELECT * FROM joined")
    _op("clip_plan", lambda s, d: audio.clip_plan(audio.merge_regions(_regions(s, d))), "SELECT clip_id, start_ms, end_ms, clip_start, least(clip_start + end_ms - start_ms, 30000) AS clip_end FROM clips WHERE clip_start < 30000")
    _op("running_progress", lambda s, d: stats.running_progress(D.run_log(s, d)), "SELECT book_id, ord, done, ok, done - ok AS fail, round(a, 4) AS avg_seconds, round(a * (total - done), 4) AS remaining_seconds FROM (SELECT book_id, ord, count(*) OVER w AS done, (sum((status='ok')::INT) OVER w)::BIGINT AS ok, avg(seconds) OVER w AS a, count(*) OVER (PARTITION BY book_id) AS total FROM run_log WINDOW w AS (PARTITION BY book_id ORDER BY ord ROWS UNBOUNDED PRECEDING))")
    # sorts and listings
    _op("order_segments", lambda s, d: timeline.order_segments(D.segments(s, d)), "SELECT * FROM segments")
    _op("order_files", lambda s, d: timeline.order_files(D.files(s, d).select("book_id", "path")), "SELECT book_id, path, ord AS stem FROM files")
    _op("head_listing", lambda s, d: stats.head_listing(D.dialogues(s, d)), "SELECT book_id, ord, speaker, substr(text, 1, 30) AS preview, printf('%05d.wav', ord) AS file FROM dialogues WHERE ord < 10")
    _op("line_slice", lambda s, d: stats.line_slice(D.lines(s, d), D.labels(s, d), 3, 14), "SELECT book_id, pos, line, label FROM (SELECT book_id, line_no - 1 AS pos, line FROM lines WHERE line_no - 1 BETWEEN 3 AND 13) FULL JOIN (SELECT book_id, ord AS pos, label FROM labels WHERE ord BETWEEN 3 AND 13) USING (book_id, pos)")
    _op("extract_chapters", lambda s, d: parsing.extract_chapters(D.lines(s, d)), "SELECT book_id, line_no, text AS title FROM parsed WHERE kind='chapter'")
    # JSON helpers, and model labelling
    _op("json_in_text", lambda s, d: _replies(s, d).select("book_id", "ord", T.json_in_text(F.col("reply"), labeling.MOOD)["evidence"].alias("evidence")), "SELECT book_id, ord, CASE WHEN length(text) % 11 <> 0 THEN 'n=' || length(text) END AS evidence FROM dialogues")
    _op("decode_arguments", lambda s, d: D.table(s, d, "events").select("event_id", T.decode_arguments(F.when(F.col("event_id") % 5 == 0, "{broken").otherwise(F.col("props")))["k"].alias("k")), "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN props::JSON ->> 'k' END AS k FROM events")
    _op("gender_requests", lambda s, d: labeling.gender_requests(context.character_corpus(D.dialogues(s, d))), "SELECT book_id, speaker, 'Character: ' || speaker || chr(10) || 'Lines: ' || lines || chr(10) || corpus AS request FROM corpus")
    _op("emotion_requests", lambda s, d: labeling.emotion_requests(D.dialogues(s, d), _contexts(s, d)), "SELECT book_id, ord, 'Speaker: ' || speaker || chr(10) || 'Dialogue: ' || text || chr(10) || 'Context:' || chr(10) || context AS request FROM dialogues JOIN ctx USING (book_id, ord)")
    _op("apply_model", lambda s, d: _replies(s, d).select("book_id", "ord", "status"), "SELECT book_id, ord, CASE WHEN length(text) % 11 = 0 THEN 'error' ELSE 'ok' END AS status FROM dialogues")
    _op("apply_model_batched", lambda s, d: _batched_replies(s, d).select("book_id", "ord", "status", "reply"), f"""SELECT book_id, ord, CASE WHEN n % 11 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN n % 11 = 0 THEN 'Error: no answer' ELSE
  'Sure: {{"emotion": "' || {T.EMOTIONS}[n % 7 + 1] || '", "tone": "' || {T.TONES}[n % 5 + 1] || '", "confidence": 0.5, "evidence": "n=' || n || '"}} done' END AS reply FROM (SELECT *, length(text) AS n FROM dialogues)""")
    _op("label_resumably", _resumed, """SELECT book_id, ord, CASE WHEN ord % 5 = 0 THEN 'three:' || (length(text) + 1) WHEN ord % 2 = 0 THEN 'one:' || length(text) ELSE 'two:' || length(text) END AS reply, 'ok' AS status, 3 AS step FROM dialogues
UNION ALL SELECT book_id, ord, 'four:' || (length(text) + (ord % 5 = 0)::INT), 'ok', 4 FROM dialogues WHERE ord % 3 = 0""")
    _op("label_genders", _labelled_genders, """SELECT book_id, speaker, CASE speaker WHEN 'user' THEN 'female' ELSE 'male' END AS gender, CASE speaker WHEN 'guest' THEN 0.3 ELSE 0.8 END::DOUBLE AS confidence,
  CASE speaker WHEN 'guest' THEN 'no verdict' ELSE length('Character: ' || speaker || chr(10) || 'Lines: ' || lines || chr(10) || corpus)::VARCHAR END AS evidence FROM corpus""")
    _op("parse_gender_reply", _gender_replies, "SELECT book_id, ord, speaker, CASE length(text) % 3 WHEN 1 THEN 'female' ELSE 'male' END AS gender, CASE length(text) % 3 WHEN 1 THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence, CASE length(text) % 3 WHEN 0 THEN '' WHEN 1 THEN 'e' ELSE 'no verdict' END AS evidence FROM dialogues")
    _op("parse_emotion_reply", lambda s, d: labeling.parse_emotion_reply(_replies(s, d)), f"SELECT book_id, ord, CASE WHEN n % 11 = 0 THEN 'calm' ELSE {T.EMOTIONS}[n % 7 + 1] END AS emotion, CASE WHEN n % 11 = 0 THEN 'serious' ELSE {T.TONES}[n % 5 + 1] END AS tone, CASE WHEN n % 11 = 0 THEN 0 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN n % 11 = 0 THEN '' ELSE 'n=' || n END AS evidence FROM (SELECT *, length(text) AS n FROM dialogues)")
    _op("render_search", lambda s, d: context.render_search(_searched(s, d), _asked(s, D.document_lines(s, d), D.KEYWORDS)), """, r AS (SELECT keyword, book_id, string_agg('Line ' || line_no || ': ' || line, chr(10) ORDER BY line_no) AS body, count(*) AS shown, max(total) AS total FROM found WHERE rn <= 20 GROUP BY ALL)
SELECT keyword, book_id, 'Found ' || coalesce(total, 0) || ' matches' || CASE WHEN total > shown THEN ' (showing ' || shown || ' of ' || total || ')' ELSE '' END || coalesce(':' || chr(10) || body, chr(10) || 'No matches found') AS output FROM (SELECT DISTINCT doc_id AS book_id, keyword FROM documents, words WHERE text IS NOT NULL) LEFT JOIN r USING (keyword, book_id)""")
    _op("render_range", lambda s, d: context.render_range(_ranges(s, d)), """SELECT book_id, "start", "end", CASE WHEN text = '' AND NOT truncated THEN 'No lines in range' ELSE text || CASE WHEN truncated THEN chr(10) || '... (truncated)' ELSE '' END END AS output FROM ranges""")
    _op("render_mentions", lambda s, d: context.render_mentions(_mentions_shown(s, d), _asked(s, D.lines(s, d), ["user", "assistant"])), """, r AS (SELECT keyword, book_id, string_agg('Line ' || line_no || ': ' || line, chr(10) ORDER BY line_no) AS body, count(*) AS shown FROM mentions WHERE rn <= 20 GROUP BY ALL)
SELECT keyword, book_id, CASE WHEN body IS NULL THEN 'No dialogues found for ''' || keyword || '''' ELSE 'Found ' || shown || ' dialogues:' || chr(10) || body END AS output FROM (SELECT DISTINCT book_id, keyword FROM lines, (VALUES ('user'), ('assistant')) n(keyword)) LEFT JOIN r USING (keyword, book_id)""")
    _op("gender_cues", lambda s, d: context.gender_cues(D.lines(s, d), ["user", "assistant"], "he", "la"), """, a AS (SELECT DISTINCT keyword, book_id, line_no + x AS line_no FROM lines JOIN (VALUES ('user'), ('assistant')) n(keyword) ON contains(line, keyword), (VALUES (-1), (0), (1)) o(x))
SELECT keyword, book_id, sum(len(regexp_extract_all(line, 'he')))::BIGINT AS he, sum(len(regexp_extract_all(line, 'la')))::BIGINT AS she FROM a JOIN lines USING (book_id, line_no) GROUP BY ALL""")
    _op("emotion_cues", lambda s, d: context.emotion_cues(D.dialogues(s, d), "he|la"), f"SELECT book_id, ord, len(regexp_extract_all(text, '[!！]')) AS exclaims, len(regexp_extract_all(text, '[?？]')) AS asks, len(regexp_extract_all(text, '…')) AS pauses, len(regexp_extract_all(text, '[.,]')) AS stops, coalesce(lag(speaker = '{T.NARRATOR}') OVER w, false) AS told_before, coalesce(lead(speaker = '{T.NARRATOR}') OVER w, false) AS told_after, coalesce(lag(c) OVER w, 0)::BIGINT AS cues_before, coalesce(lead(c) OVER w, 0)::BIGINT AS cues_after FROM (SELECT *, CASE WHEN speaker = '{T.NARRATOR}' THEN len(regexp_extract_all(text, 'he|la')) END AS c FROM dialogues) WINDOW w AS (PARTITION BY book_id ORDER BY ord)")
    # one huge book made of all books, and one clip made of all clips: numbered with gaps, so that they lie in many ranges
    _op("dialogue_table_one_book", _one_book, f""", b AS (
  SELECT *, book_id * {GAP} + line_no AS place, sum((kind = 'dialogue')::INT) OVER (ORDER BY book_id, line_no) - 1 AS kk,
    coalesce(last_value(CASE WHEN kind='chapter' THEN text END IGNORE NULLS) OVER (ORDER BY book_id, line_no ROWS UNBOUNDED PRECEDING), '') AS head FROM parsed
), named AS (
  SELECT b.*, CASE WHEN kind = 'dialogue' AND kk < {GAP} THEN CASE (kk % 5)::INT WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' WHEN 2 THEN '{T.NARRATOR}' WHEN 3 THEN '' ELSE 'guest' END ELSE speaker END AS who
  FROM b WHERE kind='dialogue' OR (kind='narrative' AND length(text) > 5)
) SELECT 0::BIGINT AS book_id, row_number() OVER (ORDER BY place) - 1 AS ord, place AS line_no, head AS chapter, text, CASE WHEN kind='narrative' THEN '{T.NARRATOR}' ELSE who END AS speaker FROM named""")
    _op("splice_timeline_one_book", _one_timeline, f""", s AS (SELECT *, book_id * {GAP} + ord AS place FROM segments), g AS (
  SELECT *, CASE WHEN lag(chapter) OVER w IS NULL THEN 0 WHEN lag(chapter) OVER w <> chapter THEN 2000 ELSE 300 END::BIGINT AS gap_ms FROM s WINDOW w AS (ORDER BY place)
), t AS (SELECT *, (sum(gap_ms + duration_ms) OVER (ORDER BY place))::BIGINT AS end_ms FROM g)
SELECT place AS ord, chapter, duration_ms, gap_ms, end_ms - duration_ms AS start_ms, end_ms FROM t""")
    _op("reference_regions_one_clip", _one_clip, f""", f AS (SELECT clip_id * {GAP} + frame_idx AS place, rms > 40.0 AS loud FROM frames), m AS (
  SELECT *, (loud AND NOT coalesce(lag(loud) OVER w, false))::INT AS new, coalesce(lead(place) OVER w, place) AS nxt FROM f WINDOW w AS (ORDER BY place)
), r AS (SELECT min(place) * 100 AS start_ms, max(nxt) * 100 AS end_ms FROM (SELECT *, sum(new) OVER (ORDER BY place) AS run FROM m) WHERE loud GROUP BY run
), j AS (SELECT min(start_ms)::BIGINT AS start_ms, max(end_ms)::BIGINT AS end_ms FROM (SELECT *, sum(new) OVER (ORDER BY start_ms) AS run FROM (
  SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (ORDER BY start_ms) < 300 THEN 0 ELSE 1 END AS new FROM r)) GROUP BY run
), c AS (SELECT *, (coalesce(sum(end_ms - start_ms + 100) OVER (ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS clip_start FROM j)
SELECT 0::BIGINT AS clip_id, start_ms, end_ms, clip_start, clip_start + end_ms - start_ms AS clip_end FROM c""")
    # composites
    _op("parse_book", lambda s, d: jobs.parse_book(D.lines(s, d), D.labels(s, d)), "SELECT * FROM speakers")
    _op("dialogue_table", lambda s, d: D.dialogues(s, d), all_d)
    _op("synthesis_jobs", _synthesis, """, j AS (SELECT *, CASE WHEN phrase = '' THEN '' ELSE '(' || phrase || ')' END AS style FROM styled WHERE NOT (ord%3=0 AND ord%9<>0))
SELECT book_id, ord, chapter, speaker, ref_audio, style, replace(style || text, chr(10), ' ') AS text, printf('%05d.wav', ord) AS output_path FROM j""")
    _op("preset_jobs", _presets, "SELECT book_id, ord, chapter, speaker, text, CASE WHEN speaker='assistant' THEN 'clone' ELSE 'preset' END AS engine, CASE WHEN speaker='assistant' THEN 'a.wav' WHEN gender='male' THEN 'male_voice' ELSE 'female_voice' END AS voice, printf('%05d_%s.wav', ord, speaker) AS output_path FROM gendered WHERE NOT (ord%3=0 AND ord%9<>0)")
    _op("volume_timeline", lambda s, d: jobs.volume_timeline(*_volume(s, d)), "SELECT book_id, ord, chapter, engine, readable, duration_ms, gap_ms, end_ms - duration_ms AS start_ms, end_ms, CASE WHEN duration_ms >= 100 THEN 50 ELSE 0 END::BIGINT AS fade_ms FROM volume_line")
    _op("volume_report", lambda s, d: jobs.volume_report(*_volume(s, d)), """, m AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY f) AS file_index FROM (SELECT book_id, chapter, min(ord) AS f, count(*) AS segments, sum(duration_ms)::BIGINT AS duration_ms FROM volume_line GROUP BY ALL)),
v AS (SELECT book_id, max(end_ms) AS volume_ms FROM volume_line GROUP BY book_id), z AS (SELECT book_id, round(sum(length) / 1048576, 4) AS size_mb FROM files GROUP BY book_id)
SELECT book_id, file_index, CASE WHEN chapter='' THEN 'chapter_' || file_index ELSE chapter END AS title, segments, duration_ms, volume_ms, size_mb FROM m JOIN v USING (book_id) LEFT JOIN z USING (book_id)""")
    _op("reference_clip_plan", lambda s, d: jobs.reference_clip_plan(D.frames(s, d).select("clip_id", F.col("frame_idx").alias("sample_idx"), F.col("rms").alias("v")), 45.0, 16, 4, 100), """, c AS (SELECT *, (coalesce(sum(end_ms-start_ms+100) OVER (PARTITION BY clip_id ORDER BY start_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS clip_start FROM level_joined),
t AS (SELECT clip_id, count(*) * 100 AS total_ms FROM levels GROUP BY ALL), r AS (SELECT clip_id, count(*) AS regions, sum(end_ms - start_ms)::BIGINT AS speech_ms FROM level_joined GROUP BY ALL)
SELECT clip_id, start_ms, end_ms, clip_start, least(clip_start + end_ms - start_ms, 30000) AS clip_end, regions, speech_ms, round(speech_ms / total_ms, 4) AS ratio FROM c JOIN t USING (clip_id) JOIN r USING (clip_id) WHERE clip_start < 30000""")
    _op("dry_run_segments", lambda s, d: jobs.dry_run_segments(D.dialogues(s, d)), "SELECT book_id, ord, chapter, speaker, printf('%05d_%s.wav', ord, speaker) AS audio_path FROM dialogues")


_register()


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL over the driver's views, for each query."""
    return dict(_sql)
