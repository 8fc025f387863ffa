"""DuckDB SQL for the platformer rules, over one row per cell.

Written with windows, joins and recursive CTEs only, so that it shares nothing
with the bitmap expressions it checks.
"""

from __future__ import annotations

from scenewright.fixtures import scene_sql

SOLID = "('X','S','?','Q','<','>','[',']','B','b')"
PIPE = "('<','>','[',']')"


def q(n: str) -> str:
    """Quantity word of an integer expression."""
    return (f"CASE WHEN {n}=0 THEN 'no' WHEN {n}=1 THEN 'one' WHEN {n}=2 THEN 'two' "
            f"WHEN {n}<5 THEN 'a few' WHEN {n}<10 THEN 'several' ELSE 'many' END")


def said(n: str, one: str, many: str) -> str:
    return (f"CASE WHEN {n}>0 THEN ' '||({q(n)})||CASE WHEN {n}>1 THEN ' {many}.' "
            f"ELSE ' {one}.' END ELSE '' END")


def plural(n: str, word: str) -> str:
    return f"({q(n)})||' {word}'||CASE WHEN {n}=1 THEN '' ELSE 's' END"


BASE = "WITH RECURSIVE " + scene_sql() + f""",
ids AS (SELECT scene_id FROM fx_grid),
cells AS (
  SELECT scene_id, r, c, ch, ch IN {SOLID} AS solid, ch IN {PIPE} AS pipe, ch IN ('-','o') AS pass
  FROM fx_cells),
near AS (
  SELECT *, lag(ch) OVER h AS lf, lead(ch) OVER h AS rt, lag(ch) OVER v AS up,
         coalesce(lag(solid) OVER v, false) AS sup, coalesce(lead(solid) OVER v, false) AS sdn
  FROM cells WINDOW h AS (PARTITION BY scene_id, r ORDER BY c), v AS (PARTITION BY scene_id, c ORDER BY r)),
counts AS (
  SELECT scene_id, count(*) FILTER (ch='E') AS enemies, count(*) FILTER (ch IN ('Q','?')) AS questions,
    count(*) FILTER (ch='B') AS cannons, count(*) FILTER (ch='o') AS coins,
    count(*) FILTER (ch='b' AND (up IS NULL OR up NOT IN ('B','b'))) AS broken,
    count(*) FILTER (r<15 AND ch='o' AND coalesce(lf,'')<>'o' AND rt='o') AS coin_lines
  FROM near GROUP BY scene_id),
rowstat AS (
  SELECT scene_id, r, count(*) FILTER (solid) AS ns, count(*) FILTER (pass) AS np,
    count(*) FILTER ((pass OR ch='E') AND NOT coalesce(lf IN ('-','o','E'), false)) AS gaps,
    count(*) FILTER (solid AND NOT coalesce(lf IN {SOLID}, false)) AS chunks
  FROM near GROUP BY scene_id, r),
floors AS (
  SELECT scene_id, CASE WHEN ns=16 THEN 'full floor' WHEN np=16 THEN ''
    WHEN ns>np THEN 'floor with '||{plural('gaps', 'gap')}
    ELSE 'giant gap with '||{plural('chunks', 'chunk')}||' of floor' END AS floor_text
  FROM rowstat WHERE r=15),
ceils AS (
  SELECT scene_id, r, CASE WHEN ns=16 THEN ' full ceiling.'
    WHEN ns>8 THEN ' ceiling with '||{plural('gaps', 'gap')}||'.' ELSE '' END AS t,
    CASE WHEN ns=16 THEN 0 WHEN ns>8 THEN CASE WHEN gaps=1 THEN 1 WHEN gaps=2 THEN 2 WHEN gaps<5 THEN 3
      WHEN gaps<10 THEN 4 ELSE 5 END ELSE 9 END AS rank
  FROM rowstat WHERE r<=4),
ceilpair AS (
  SELECT a.scene_id, a.r, CASE WHEN a.rank<b.rank THEN a.r ELSE b.r END AS chosen
  FROM ceils a JOIN ceils b ON a.scene_id=b.scene_id AND b.r=a.r-1 WHERE a.rank<9 OR b.rank<9),
ceilpick AS (SELECT scene_id, max_by(chosen, r) AS cr FROM ceilpair GROUP BY scene_id),
ceiling AS (
  SELECT i.scene_id, p.cr, coalesce(c.t, '') AS ceiling_text
  FROM ids i LEFT JOIN ceilpick p USING (scene_id)
  LEFT JOIN ceils c ON c.scene_id=i.scene_id AND c.r=p.cr),
ceilrows AS (
  SELECT p.scene_id, f.r FROM ceilpick p JOIN fx_rows k ON k.scene_id=p.scene_id AND k.r=p.cr
  JOIN fx_rows f ON f.scene_id=p.scene_id AND (f.r=p.cr OR (f.r<p.cr AND p.cr>0 AND f.line=k.line))),
floorrows AS (
  SELECT scene_id, 15 AS r FROM ids UNION ALL
  SELECT a.scene_id, 14 FROM fx_rows a JOIN fx_rows b USING (scene_id)
  WHERE a.r=15 AND b.r=14 AND a.line=translate(b.line,'<>','[]')),
plat0 AS (
  SELECT n.scene_id, r, c FROM near n JOIN ceiling k USING (scene_id)
  WHERE solid AND NOT pipe AND r BETWEEN 1 AND 14 AND NOT sup AND NOT sdn AND r IS DISTINCT FROM k.cr),
plat1 AS (SELECT *, c-row_number() OVER (PARTITION BY scene_id, r ORDER BY c) AS g FROM plat0),
platruns AS (
  SELECT scene_id, r, min(c) AS c0, max(c) AS c1 FROM plat1 GROUP BY scene_id, r, g HAVING count(*)>=2),
tops AS (
  SELECT scene_id, r, c FROM near WHERE solid AND (r=0 OR NOT sup)
  UNION ALL SELECT scene_id, r-16, c FROM near WHERE solid),
up3 AS (
  SELECT a.scene_id, a.c, a.r FROM tops a JOIN tops b ON b.scene_id=a.scene_id AND b.c=a.c+1 AND b.r=a.r-1
  JOIN tops d ON d.scene_id=a.scene_id AND d.c=a.c+2 AND d.r=a.r-2),
down3 AS (
  SELECT a.scene_id, a.c, a.r FROM tops a JOIN tops b ON b.scene_id=a.scene_id AND b.c=a.c+1 AND b.r=a.r+1
  JOIN tops d ON d.scene_id=a.scene_id AND d.c=a.c+2 AND d.r=a.r+2 WHERE a.r>=0),
stair3 AS (
  SELECT 'ascending' AS kind, -1 AS v, * FROM up3 UNION ALL SELECT 'descending', 1, * FROM down3),
stairdiag AS (
  SELECT *, r-v*c AS d, c-row_number() OVER (PARTITION BY kind, scene_id, r-v*c ORDER BY c) AS g FROM stair3),
stairlen AS (
  SELECT kind, v, scene_id, c, r, 2+count(*) OVER (PARTITION BY kind, scene_id, d, g ORDER BY c
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM stairdiag),
staircand AS (
  SELECT kind, v, scene_id, c, min(r) AS r, min_by(n, r) AS n FROM stairlen
  WHERE (v=1 AND r BETWEEN 0 AND 13) OR (v=-1 AND r BETWEEN 3 AND 15) GROUP BY kind, v, scene_id, c),
stairnext AS (
  SELECT a.kind, a.scene_id, a.c, min(b.c) AS nc FROM staircand a JOIN staircand b
  ON a.kind=b.kind AND a.scene_id=b.scene_id AND b.c>=a.c+a.n GROUP BY a.kind, a.scene_id, a.c),
stairwalk AS (
  SELECT kind, scene_id, min(c) AS c FROM staircand GROUP BY kind, scene_id
  UNION ALL SELECT w.kind, w.scene_id, x.nc FROM stairwalk w JOIN stairnext x USING (kind, scene_id, c)),
stairs AS (SELECT s.* FROM staircand s JOIN stairwalk w USING (kind, scene_id, c)),
stairseeds AS (
  SELECT DISTINCT scene_id, CAST(r+v*j AS INT) AS r, CAST(c+j AS INT) AS c
  FROM stairs, LATERAL (SELECT unnest(range(0, n)) AS j) WHERE r+v*j>0),
vrun AS (
  SELECT scene_id, r, c, r-row_number() OVER (PARTITION BY scene_id, c ORDER BY r) AS g FROM cells WHERE solid),
staircells AS (
  SELECT DISTINCT b.scene_id, b.r, b.c FROM stairseeds s JOIN vrun a USING (scene_id, r, c)
  JOIN vrun b ON b.scene_id=a.scene_id AND b.c=a.c AND b.g=a.g AND b.r>=a.r),
claimed AS (
  SELECT scene_id, r, c FROM cells JOIN floorrows USING (scene_id, r)
  UNION SELECT scene_id, r, c FROM cells JOIN ceilrows USING (scene_id, r)
  UNION SELECT scene_id, r, CAST(unnest(range(c0, c1+1)) AS INT) FROM platruns
  UNION SELECT * FROM staircells UNION SELECT scene_id, r, c FROM cells WHERE ch='B'),
free AS (
  SELECT scene_id, r, c, r*16+c AS i FROM cells ANTI JOIN claimed USING (scene_id, r, c) WHERE solid AND NOT pipe),
blockreach AS (
  SELECT scene_id, i, i AS lab FROM free
  UNION SELECT b.scene_id, f.i, b.lab FROM blockreach b JOIN free f ON f.scene_id=b.scene_id AND f.i>b.lab
    AND ((f.i=b.i+1 AND f.c>0) OR (f.i=b.i-1 AND f.c<15) OR f.i=b.i+16 OR f.i=b.i-16)),
blocklab AS (SELECT scene_id, i, min(lab) AS lab FROM blockreach GROUP BY scene_id, i),
blockbox AS (
  SELECT scene_id, lab, min(i//16) AS r0, max(i//16) AS r1, min(i%16) AS c0, max(i%16) AS c1, count(*) AS n
  FROM blocklab GROUP BY scene_id, lab HAVING count(*)>=3),
blockkind AS (
  SELECT b.scene_id, lab, CASE WHEN NOT coalesce(k.cr BETWEEN r0 AND r1, false) AND c1-c0<=1 AND r1-r0>=2
      AND f.fr-1 BETWEEN r0 AND r1 THEN 'tower'
    WHEN n=(r1-r0+1)*(c1-c0+1) THEN 'rectangular block cluster' ELSE 'irregular block cluster' END AS kind
  FROM blockbox b JOIN ceiling k USING (scene_id)
  JOIN (SELECT scene_id, min(r) AS fr FROM floorrows GROUP BY scene_id) f USING (scene_id)),
pipecells AS (SELECT scene_id, r, c, ch, r*16+c AS i FROM cells WHERE pipe),
pipereach AS (
  SELECT scene_id, i, ch, i AS lab FROM pipecells
  UNION SELECT b.scene_id, f.i, f.ch, b.lab FROM pipereach b JOIN pipecells f ON f.scene_id=b.scene_id AND f.i>b.lab
    AND ((f.i=b.i+1 AND f.c>0 AND b.ch NOT IN ('>',']')) OR (f.i=b.i-1 AND f.c<15 AND b.ch NOT IN ('<','['))
      OR f.i=b.i+16 OR f.i=b.i-16)),
pipelab AS (SELECT scene_id, i, min(lab) AS lab FROM pipereach GROUP BY scene_id, i),
pipebox AS (
  SELECT scene_id, lab, min(i//16) AS r0, max(i//16) AS r1, min(i%16) AS c0, count(*) AS n
  FROM pipelab GROUP BY scene_id, lab),
pairs AS (
  SELECT scene_id, r, c, ch AS a, coalesce(rt,'') AS b FROM near),
pipewalk AS (
  SELECT x.scene_id, x.lab, x.c0,
    max(p.a) FILTER (p.r=x.r0) AS ta, max(p.b) FILTER (p.r=x.r0) AS tb,
    max(p.a) FILTER (p.r=x.r1) AS ba, max(p.b) FILTER (p.r=x.r1) AS bb,
    min_by(p.a||p.b, p.r) FILTER (p.r>x.r0 AND p.a||p.b NOT IN ('<>','[]')) AS down2,
    min_by(p.a, p.r) FILTER (p.r>x.r0 AND p.a NOT IN ('>',']')) AS downl,
    min_by(p.a, p.r) FILTER (p.r>x.r0 AND p.a NOT IN ('<','[')) AS downr,
    max_by(p.a||p.b, p.r) FILTER (p.r<x.r1 AND p.a||p.b NOT IN ('<>','[]')) AS up2,
    max_by(p.a, p.r) FILTER (p.r<x.r1 AND p.a NOT IN ('>',']')) AS upl,
    max_by(p.a, p.r) FILTER (p.r<x.r1 AND p.a NOT IN ('<','[')) AS upr
  FROM pipebox x JOIN pairs p ON p.scene_id=x.scene_id AND p.c=x.c0 GROUP BY x.scene_id, x.lab, x.c0),
pipekind AS (
  SELECT scene_id, lab, CASE
    WHEN c0=0 AND ta='>' AND coalesce(downl NOT IN ('<','['), true) THEN 'pipe'
    WHEN c0=15 AND ta='<' AND coalesce(downr NOT IN ('>',']'), true) THEN 'pipe'
    WHEN c0<15 AND ta='<' AND tb='>' AND coalesce(NOT regexp_matches(down2, '[<>\\[\\]]'), true) THEN 'pipe'
    WHEN c0=0 AND ba='>' AND coalesce(upl NOT IN ('<','[','-'), true) THEN 'upside down pipe'
    WHEN c0=15 AND ba='<' AND coalesce(upr NOT IN ('>',']','-'), true) THEN 'upside down pipe'
    WHEN c0<15 AND ba='<' AND bb='>' AND coalesce(NOT regexp_matches(up2, '[<>\\[\\]-]'), true) THEN 'upside down pipe'
    ELSE 'broken pipe' END AS kind
  FROM pipewalk),
loose AS (
  SELECT scene_id, count(*) AS n FROM cells ANTI JOIN claimed USING (scene_id, r, c)
  LEFT JOIN (SELECT l.scene_id, i//16 AS r, i%16 AS c FROM blocklab l JOIN blockbox USING (scene_id, lab)) b
    USING (scene_id, r, c) WHERE ch IN ('X','S') AND b.scene_id IS NULL GROUP BY scene_id),
kinds AS (
  SELECT scene_id, 0 AS part, kind, count(*) AS n, min(lab) AS lab FROM pipekind GROUP BY scene_id, kind
  UNION ALL SELECT scene_id, 1, kind, count(*), min(lab) FROM blockkind GROUP BY scene_id, kind),
stairn AS (
  SELECT scene_id, count(*) FILTER (kind='ascending') AS na, count(*) FILTER (kind='descending') AS nd
  FROM stairs GROUP BY scene_id),
platn AS (SELECT scene_id, count(*) AS n FROM platruns GROUP BY scene_id)
"""


def captions(absence: bool = False) -> str:
    """The whole check as CTEs up to ``captions(scene_id, caption)``."""
    no = lambda text: f"' no {text}.'" if absence else "''"

    def count(n: str, one: str, many: str, always: bool = True) -> str:
        other = no(many) if always else "''"
        return said(n, one, many)[: -len("ELSE '' END")] + f"ELSE {other} END"

    texts = ",\n".join(
        f"kindtext{part} AS (SELECT i.scene_id, coalesce(string_agg(CASE WHEN n=1 THEN ' one '||kind"
        f"||'.' ELSE ' '||({q('n')})||' '||kind||'s.' END, '' ORDER BY lab) FILTER (part={part}), '')"
        + "".join(f" || CASE WHEN coalesce(bool_or(kind='{k}'), false) THEN '' ELSE {no(k + 's')} END"
                  for k in names)
        + " AS t FROM ids i LEFT JOIN kinds k ON k.scene_id=i.scene_id GROUP BY i.scene_id)"
        for part, names in enumerate((["pipe", "upside down pipe"],
                                      ["tower", "rectangular block cluster",
                                       "irregular block cluster"])))
    floor = "CASE WHEN floor_text='' THEN " + ("'no floor.'" if absence else "''") + \
        " ELSE floor_text||'.' END"
    ceil = f"CASE WHEN ceiling_text='' THEN {no('ceiling')} ELSE ceiling_text END"
    return BASE + f""",
{texts},
captions AS (
  SELECT scene_id, trim({floor} || {ceil}
    || {count('enemies', 'enemy', 'enemies')} || {count('questions', 'question block', 'question blocks')}
    || {count('cannons', 'cannon', 'cannons')} || {count('broken', 'broken cannon', 'broken cannons', False)}
    || {count('coins', 'coin', 'coins')} || {count('coin_lines', 'coin line', 'coin lines')}
    || {count('coalesce(platn.n,0)', 'platform', 'platforms')}
    || {said('coalesce(na,0)', 'ascending staircase', 'ascending staircases')}
    || {said('coalesce(nd,0)', 'descending staircase', 'descending staircases')}
    || CASE WHEN coalesce(na,0)=0 THEN {no('ascending staircases')} ELSE '' END
    || CASE WHEN coalesce(nd,0)=0 THEN {no('descending staircases')} ELSE '' END
    || kindtext0.t || kindtext1.t || {count('coalesce(loose.n,0)', 'loose block', 'loose blocks')}) AS caption
  FROM counts JOIN floors USING (scene_id) JOIN ceiling USING (scene_id)
  JOIN kindtext0 USING (scene_id) JOIN kindtext1 USING (scene_id)
  LEFT JOIN platn USING (scene_id) LEFT JOIN stairn USING (scene_id) LEFT JOIN loose USING (scene_id))
"""
