"""Built-in rules. Patterns use explicit ASCII classes and no look-around, so other engines read them alike."""

from __future__ import annotations

from sievework.operators.rulebook_more import RULES as MORE
from sievework.operators.rules import Rule

TS, PY, RS, GO, JV, CPP, GD, CS = ("ts", "js"), ("py",), ("rust",), ("go",), ("java",), ("cpp",), ("gd",), ("cs",)

RULES = [
    Rule("TS-A02", "P0", "default on a number of a configuration without clamp", r"(cfg|config|opts|options)\.[A-Za-z0-9_.]+ *\?\? *-?[0-9]", TS, "W", absent=r"clamp|isFinite|Math\.(min|max)", win=4, scene="s-numerics"),
    Rule("TS-A03", "P0", "clamp of an external value lets NaN pass", r"clamp[A-Za-z0-9_]*\( *(cfg|config|input|data|payload)", TS, "W", absent=r"isFinite|isNaN", win=6, scene="s-numerics"),
    Rule("TS-A05", "P1", "unsigned shift or bit-or turns NaN into 0", r">>> *0|\| *0 *[;,)]", TS, scene="s-numerics"),
    Rule("TS-B01", "P0", "loop bound comes from a parameter", r"for *\(.*< *(count|size|limit|max|total)[A-Za-z0-9_]* *;", TS, "W", absent=r"Math\.min|clamp|isFinite", win=6, scene="s-numerics"),
    Rule("TS-B02", "P0", "while loop over a float condition", r"while *\( *[A-Za-z0-9_.]+ *[<>] *[A-Za-z0-9_.]+ *\)", TS, "F", scene="s-numerics"),
    Rule("TS-C01", "P0", "table look-up reaches the prototype", r"[A-Za-z_]+(Table|Map|Dict)\[[A-Za-z_.]+\]", TS, "W", absent=r"hasOwn|Object\.create\(null\)|new Map", win=8, scene="s-structures"),
    Rule("TS-C02", "P1", "object literal as a counter map", r"(counts?|counter|tally)[A-Za-z0-9_]*( *:[^=]+)? *= *\{ *\}", TS, scene="s-structures"),
    Rule("TS-C03", "P1", "merge of an external object", r"Object\.assign\(|\.\.\.(input|data|payload|body)", TS, scene="s-structures"),
    Rule("APP-J01", "P1", "message listener without origin check", r"addEventListener\( *['\"]message['\"]", TS, "W", absent=r"\.origin", win=20, scene="s-boundary", cwe=("CWE-346",)),
    Rule("APP-J02", "P1", "dynamic member call without allow-list", r"[A-Za-z_]+\[[A-Za-z_]+\]\(", TS, scene="s-sandbox"),
    Rule("APP-J03", "P1", "postMessage to any target", r"postMessage\([^)]*['\"]\*['\"]", TS, scene="s-boundary", cwe=("CWE-346",)),
    Rule("APP-J04", "P2", "stored value parsed without fallback", r"JSON\.parse\( *(localStorage|sessionStorage)", TS, "W", absent=r"try|catch", win=6, scene="s-state"),
    Rule("APP-J06", "P2", "capability probe cached once", r"let [A-Za-z_]*(supported|available|degraded)[A-Za-z_]* *= *(null|undefined)", TS, scene="s-state"),
    Rule("APP-K17", "P1", "binds all interfaces", r"0\.0\.0\.0", (), scene="s-boundary", cwe=("CWE-1327",)),
    Rule("APP-K08", "P0", "shell wrapper with external input", r"(exec|execSync|system|popen)\( *(`[^`]*\$\{|[^'\"`)]*\+)", (), scene="s-sandbox", cwe=("CWE-78",)),
    Rule("APP-K10", "P1", "command arguments put together as one string", r"(cmd|command|args)[A-Za-z_]* *\+?= *['\"`][^'\"`]* ['\"`] *\+", (), scene="s-sandbox", cwe=("CWE-88",)),
    Rule("APP-K14", "P2", "probe by spawning which or where", r"(spawn|exec|run)[A-Za-z_]*\( *\[?['\"](which|where)", (), scene="s-backend"),
    Rule("APP-K16", "P1", "socket use without timeout", r"(TcpStream::connect|net\.connect|socket\.socket)\(", (), "W", absent=r"[Tt]imeout", win=12, scene="s-backend"),
    Rule("APP-K31", "P1", "return code of a child dropped", r"^ *(subprocess\.(run|call)|child_process\.exec)\(", (), "W", absent=r"check=True|returncode|\.code", win=4, scene="s-backend"),
    Rule("APP-R02", "P1", "lock result unwrapped", r"\.lock\(\)\.unwrap\(\)", RS, scene="s-concurrency"),
    Rule("APP-R03", "P0", "buffer of declared length", r"(with_capacity|vec!\[0[^;]*;) *\(? *[a-z_]*(len|size)", RS, scene="s-boundary", cwe=("CWE-770",)),
    Rule("APP-R06", "P0", "command through a shell", r"Command::new\( *(\"(sh|bash|cmd)\"|&?[a-z_]+ *\))", RS, scene="s-sandbox", cwe=("CWE-78",)),
    Rule("APP-R07", "P1", "polling by sleep", r"(thread::sleep|time\.sleep|setTimeout)\(", (), "W", present=r"loop|while", win=4, scene="s-backend"),
    Rule("APP-R10", "P2", "rename without fallback across devices", r"fs::rename\(", RS, "W", absent=r"copy", win=6, scene="s-atomicity"),
    Rule("PY-L01", "P0", "mutable default argument", r"def [A-Za-z_0-9]+\(.*= *(\[\]|\{\})", PY, scene="p-python"),
    Rule("PY-L02", "P0", "bare except", r"^ *except *(Exception)? *:", PY, "W", absent=r"raise|log|warn", win=4, scene="p-python"),
    Rule("PY-L03", "P1", "file opened without with", r"^ *[a-z_]+ *= *open\(", PY, scene="p-python"),
    Rule("PY-L05", "P0", "evaluation of text", r"[^A-Za-z_.](eval|exec)\(", PY, scene="s-sandbox", cwe=("CWE-95",)),
    Rule("PY-L06", "P1", "unsafe load", r"(pickle\.loads?|yaml\.load)\(", PY, scene="s-boundary", cwe=("CWE-502",)),
    Rule("PY-L07", "P1", "shell=True", r"shell *= *True", PY, scene="s-sandbox", cwe=("CWE-78",)),
    Rule("PY-L08", "P2", "assert for a check at run time", r"^ *assert ", PY, scene="p-python"),
    Rule("RS-01", "P0", "unwrap or expect", r"\.(unwrap|expect)\(", RS, absent=r"#\[cfg\(test\)\]", scene="p-rust"),
    Rule("RS-02", "P0", "narrowing cast", r" as (u8|u16|u32|i8|i16|i32)([^0-9]|$)", RS, scene="p-rust"),
    Rule("RS-03", "P0", "unsafe without a note on safety", r"unsafe *\{", RS, "W", absent=r"SAFETY", win=4, scene="p-rust"),
    Rule("RS-07", "P1", "error hidden", r"unwrap_or_default\(\)|let _ *=", RS, scene="p-rust"),
    Rule("RS-09", "P1", "raw pointer or transmute", r"transmute|\*(const|mut) [A-Z]", RS, scene="p-rust"),
    Rule("RS-10", "P1", "secret in a log", r"(info|debug|warn|error|println)!\(.*(token|secret|password)", RS, scene="p-rust", cwe=("CWE-532",)),
    Rule("GO-01", "P0", "goroutine without a way out", r"go func\(", GO, "W", absent=r"ctx|done|Done|WaitGroup|select", win=12, scene="p-go"),
    Rule("GO-02", "P0", "error ignored", r"_ *(,[^=]*)?:?= *[a-zA-Z_.]+\(", GO, scene="p-go"),
    Rule("GO-03", "P1", "defer in a loop", r"^\s*defer ", GO, "W", present=r"for ", win=4, scene="p-go"),
    Rule("GO-04", "P1", "lock without deferred unlock", r"\.Lock\(\)", GO, "W", absent=r"Unlock\(\)", win=6, scene="p-go"),
    Rule("GO-05", "P0", "http client without timeout", r"http\.(Get|Post)\(|http\.Client\{\}", GO, scene="p-go"),
    Rule("JV-01", "P0", "empty catch", r"catch *\([^)]*\) *\{ *\}", JV, "F", scene="p-java"),
    Rule("JV-02", "P0", "statement put together from strings", r"(createStatement|executeQuery|prepareStatement)\(.*\+", JV, scene="p-java", cwe=("CWE-89",)),
    Rule("JV-03", "P1", "strings compared by identity", r"== *\"|\" *==", JV, scene="p-java"),
    Rule("JV-04", "P1", "date format shared", r"static (final )?SimpleDateFormat", JV, scene="p-java"),
    Rule("CPP-01", "P0", "unbounded copy", r"(strcpy|strcat|sprintf|gets)\(", CPP, scene="p-cpp", cwe=("CWE-120",)),
    Rule("CPP-02", "P0", "raw new without owner", r"= *new [A-Za-z_]", CPP, absent=r"unique_ptr|shared_ptr", scene="p-cpp"),
    Rule("CPP-03", "P1", "C cast of a pointer", r"\( *[A-Za-z_]+ *\* *\) *[A-Za-z_]", CPP, scene="p-cpp"),
    Rule("GD04", "P1", "signal connected in the old style", r"\.connect\( *\"", GD, first_only=True, scene="p-godot"),
    Rule("GD06", "P1", "old coroutine yield", r"(^|[^A-Za-z_])yield\(", GD, first_only=True, scene="p-godot"),
    Rule("GD08", "P1", "old instancing", r"\.instance\(\)", GD, first_only=True, scene="p-godot"),
    Rule("GD101", "P1", "debug output left", r"^\s*print(_debug)?\(", GD, first_only=True, scene="p-godot"),
    Rule("GD102", "P1", "assert for a check at run time", r"^\s*assert\(", GD, first_only=True, scene="p-godot"),
    Rule("GD104", "P1", "absolute path literal", r"\"(/home|C:\\\\|/Users)", (), first_only=True, scene="p-godot"),
    Rule("CC-17", "P2", "console output outside of debug builds", r"console\.(log|warn)\(", TS, absent=r"CC_DEBUG", scene="p-cocos"),
    Rule("CC-19", "P2", "mask component", r"getComponent\( *Mask", TS, first_only=True, scene="p-cocos"),
    Rule("DOC-01", "P2", "to-do left in a text", r"(TODO|FIXME|XXX)[: ]", (), scene="s-build"),
    Rule("DOC-02", "P1", "secret in a text", r"(TOKEN|SECRET|PASSWORD|API_KEY) *= *\"[A-Za-z0-9]{16,}\"", (), scene="s-boundary", cwe=("CWE-798",)),
    Rule("DOC-03", "P2", "row of bars outside a table", r" \| .* \| ", (), absent=r"\|-{3}", scene="s-build"),
    Rule("DOC-04", "P2", "shouting line", r"^[A-Z!,. ]{20,}$", (), scene="s-build"),
]
RULES += MORE
