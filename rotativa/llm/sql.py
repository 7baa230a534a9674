"""SQL of the text queries that SQL can express over whole tables."""

#: Lines are equal after lower-casing and dropping ASCII digits and white space.
SQL = {
    "p3_found": """
WITH lines AS (
  SELECT DISTINCT medio_id, noticia_id, u.linea AS linea, translate(lower(u.x), '0123456789 ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS form
  FROM (SELECT medio_id, noticia_id, string_split(texto_extraido, chr(10)) AS parts FROM noticias WHERE texto_extraido IS NOT NULL),
       LATERAL (SELECT unnest(parts) AS x, generate_subscripts(parts, 1) AS linea) AS u
), size AS (SELECT medio_id, count(DISTINCT noticia_id) AS n FROM noticias GROUP BY 1),
often AS (
  SELECT l.medio_id, l.form FROM lines l JOIN size s USING (medio_id) WHERE l.form <> ''
  GROUP BY l.medio_id, l.form, s.n HAVING count(DISTINCT l.noticia_id) >= 5 AND count(DISTINCT l.noticia_id) * 100 >= s.n * 3
)
SELECT DISTINCT l.noticia_id, CAST(l.linea AS INTEGER) AS linea FROM lines l JOIN often o ON l.medio_id = o.medio_id AND l.form = o.form
""",
}
