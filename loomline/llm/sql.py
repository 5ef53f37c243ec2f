"""The same results as SQL, for the queries SQL can express on whole tables."""

#: Unicode White_Space as a class of DuckDB's regular expressions.
_WS = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_EOL = r"(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])"
#: Words in a text; splitting gives one part more than there are separators.
_WORDS = "len(list_filter(string_split_regex(@, '" + _WS + "+'), lambda w: w <> ''))"

SQL = {
    "p2_found": """
        WITH lines AS (SELECT DISTINCT recording_id, pos, start_ms FROM asr_segments WHERE start_ms IS NOT NULL AND pos IS NOT NULL AND recording_id IS NOT NULL),
        marks AS (SELECT recording_id, start_ms, min(id) AS id FROM speaker_chunks WHERE start_ms IS NOT NULL AND id IS NOT NULL AND recording_id IS NOT NULL GROUP BY ALL),
        near AS (
            SELECT l.recording_id, l.pos, l.start_ms, b.id AS b_id, l.start_ms - b.start_ms AS b_gap
            FROM lines l ASOF LEFT JOIN marks b ON l.recording_id = b.recording_id AND l.start_ms >= b.start_ms
        ), both_sides AS (
            SELECT n.*, a.id AS a_id, a.start_ms - n.start_ms AS a_gap
            FROM near n ASOF LEFT JOIN marks a ON n.recording_id = a.recording_id AND n.start_ms < a.start_ms
        )
        SELECT recording_id, CAST(pos AS BIGINT) AS pos, CASE WHEN a_gap IS NULL OR b_gap <= a_gap THEN b_id ELSE a_id END AS chunk_id
        FROM both_sides WHERE least(coalesce(a_gap, 999999), coalesce(b_gap, 999999)) <= 1500
    """,
    "p6_found": f"""
        WITH big AS (SELECT DISTINCT id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM chunks WHERE text IS NOT NULL AND {_WORDS.replace("@", "text")} > 620),
        paragraphs AS (SELECT id, unnest(string_split_regex(text, '{_EOL}{_WS}*{_EOL}')) AS p FROM big),
        longest AS (SELECT id, max({_WORDS.replace("@", "p")}) AS n FROM paragraphs GROUP BY id),
        sentences AS (SELECT id, unnest(string_split(regexp_replace(p, '([.?!]){_WS}', '\\1' || chr(1), 'g'), chr(1))) AS s FROM paragraphs),
        longest_sentence AS (SELECT id, max({_WORDS.replace("@", "s")}) AS m FROM sentences GROUP BY id)
        SELECT id AS chunk_id, CASE WHEN n <= 620 THEN 'paragraph' WHEN m <= 620 THEN 'sentence' ELSE 'word' END AS boundary
        FROM longest JOIN longest_sentence USING (id)
    """,
}
