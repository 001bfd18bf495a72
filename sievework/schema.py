"""Tables of the engine, as Spark DDL."""

FILES = "path string, module string, lang string, bytes bigint, text string"
LINES = "path string, line_no int, line string"
SPANS = "path string, name string, s int, e int"
RULES = "rule_id string, level string, title string, family string, langs array<string>, pattern string, absent string, present string, win int, first_only boolean, fix string"
FINDINGS = "rule_id string, level string, path string, line_no int, snippet string"
ITEMS = "id string, level string, name string, scene string, file string, keywords array<string>, body string, tokens int, xrefs array<string>"
SKILLS = "id string, name string, domain string, tier string, keywords array<string>, trigger string, hits int, last_used date"
EDGES = "src string, dst string"
MUTATION_OUTCOMES = "id string, result string"
