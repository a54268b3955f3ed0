"""DuckDB SQL for the adapters in model.py."""

LETTERS = "lower(regexp_replace({}, '[^A-Za-z]', '', 'g'))"
_LOWER, _BASES, _QUALS = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTNACGTACGTACGTA", "!$(+/258:;<=>?@ABCDEFGHIJK"


def reads() -> str:
    own = LETTERS.format("text")
    return f"""SELECT doc_id AS ord, 'd' || doc_id AS id, lang || ' ' || source AS "desc", lang,
  translate({own}, '{_LOWER}', '{_BASES}') AS seq, translate({own}, '{_LOWER}', '{_QUALS}') AS qual FROM documents"""


REVCOMP = "reverse(translate({}, 'ACGTUNacgtun', 'TGCAANTGCAAN'))"


def pairs() -> str:
    """Valid pairs of half mates."""
    return f"""SELECT ord, id || '/1' AS id1, "desc" AS desc1, substr(seq, 1, h) AS seq1, substr(qual, 1, h) AS qual1,
  id || '/2' AS id2, "desc" AS desc2, {REVCOMP.format('substr(seq, h + 1)')} AS seq2, reverse(substr(qual, h + 1)) AS qual2
  FROM (SELECT *, length(seq) // 2 AS h FROM ({reads()}))"""


def zipped() -> str:
    """Turn mates joined by their numbers, with a status."""
    sides = []
    for name, role, back, mate in (("r1", "user", 0, "/1"), ("r2", "assistant", 1, "/2")):
        own = LETTERS.format("text")
        sides.append(
            f"""{name} AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS ord, conv_id || '.' || (turn - {back}) || '{mate}' AS id,
  translate({own}, '{_LOWER}', '{_BASES}') AS seq, translate({own}, '{_LOWER}', '{_QUALS}') AS qual FROM conversations WHERE role = '{role}')"""
        )
    return f"""WITH {", ".join(sides)} SELECT coalesce(r1.ord, r2.ord) AS ord, r1.id AS id1, r1.seq AS seq1, r1.qual AS qual1, r2.id AS id2, r2.seq AS seq2, r2.qual AS qual2,
  CASE WHEN r2.ord IS NULL THEN 'left' WHEN r1.ord IS NULL THEN 'right'
       WHEN regexp_replace(r1.id, '/[12]$', '') = regexp_replace(r2.id, '/[12]$', '') THEN 'valid' ELSE 'mismatch' END AS status
  FROM r1 FULL OUTER JOIN r2 ON r1.ord = r2.ord"""
