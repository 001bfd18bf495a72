"""More built-in rules: (id, level, what, languages, pattern, absent or "", form). First hit of each file for engine rules.

Fixed tables of detection patterns, written for this engine."""

from __future__ import annotations

from sievework.operators.rules import Rule

TS, RS, GO, JV, CPP, GD, CS, SH = ("ts", "js"), ("rust",), ("go",), ("java",), ("cpp",), ("gd",), ("cs",), ("shader",)

SCRIPT = [
    ("TS-A01", "P0", "comparison guard that NaN passes", r"if *\( *[A-Za-z_.]+ *(<|<=|>) *0 *\) *(return|continue)", ""),
    ("TS-A04", "P0", "running state can be poisoned", r"this\.[A-Za-z_]+ *(\+=|= *this\.[A-Za-z_]+ *\+)", r"isFinite|clamp"),
    ("TS-E01", "P0", "listeners walked while callbacks may unsubscribe", r"(listeners|handlers|callbacks)\.forEach\(", r"slice\(\)|\.\.\.this"),
    ("TS-G01", "P1", "single slot for a callback", r"this\.on[A-Z][A-Za-z]+ *= *", ""),
    ("TS-I02", "P1", "full scan nested in a filter", r"\.(filter|map)\(.*\.(find|indexOf|includes)\(", ""),
    ("TS-I01", "P1", "capacity grows without bound", r"(capacity|limit|size) *(\*=|\+=) ", r"MAX_|Math\.min"),
    ("TS-J02", "P1", "empty catch", r"catch *(\([^)]*\))? *\{ *\}", ""),
    ("TS-L01", "P0", "empty if", r"if *\([^)]*\) *\{ *\}", ""),
    ("TS-L02", "P1", "both branches alike", r"\? *(true|false|null|0|1) *: *(true|false|null|0|1) *;", ""),
    ("TS-L15", "P1", "cache that is never emptied", r"[cC]ache\.set\(", r"[cC]ache\.(delete|clear)\("),
    ("TS-M01", "P0", "open default without a validator", r"(validator|validate) *\?\? *\(\(\) *=> *true", ""),
    ("TS-N01", "P1", "wall clock in logic", r"Date\.now\(\)|new Date\(\)", ""),
    ("TS-N02", "P1", "bare random numbers", r"Math\.random\(\)", ""),
    ("TS-O01", "P1", "shift beyond 32 bits", r"1 *<< *[A-Za-z_]", ""),
    ("TS-O02", "P1", "division by an unguarded variable", r"/ *(count|total|len|length|size|sum|max)[^A-Za-z]", r"(count|total|len|length|size|sum|max) *(>|===|!==|<=) *0"),
    ("TS-O03", "P1", "console output", r"console\.(log|debug)\(", ""),
    ("TS-O04", "P1", "inner state returned as it is", r"return this\._[A-Za-z]+(List|Map|Array|s) *;", ""),
    ("TS-P02", "P0", "Infinity as a mark", r"(===|!==|=) *-?Infinity", ""),
    ("TS-P03", "P0", "Math.max or min as a sanitizer", r"Math\.(max|min)\( *[0-9.]+ *, *(input|cfg|data|value)", ""),
    ("TS-P04", "P1", "negative index in slice or splice", r"\.(slice|splice)\( *[A-Za-z_]+ *- *", ""),
    ("TS-Q01", "P0", "typed array of unchecked size", r"new (Uint8|Uint16|Uint32|Int32|Float32|Float64)Array\( *[a-z_]", r"MAX_|isInteger|Math\.min"),
    ("TS-Q05", "P1", "unbounded spread into a call", r"\(\.\.\.[A-Za-z_.]+\)", ""),
    ("TS-R04", "P0", "composite key without escaping", r"\$\{[A-Za-z_.]+\}[:|/_-]\$\{[A-Za-z_.]+\}", ""),
    ("TS-S01", "P0", "debug feature on by default", r"(debug|cheat|godMode)[A-Za-z]* *[:=] *true", ""),
    ("TS-T01", "P0", "angle normalised by a loop", r"while *\( *(angle|theta|rot)[A-Za-z]* *[<>]", ""),
    ("TS-X01", "P0", "subscription without its end", r"\.(subscribe|on)\( *['\"]", r"unsubscribe|\.off\("),
    ("TS-X02", "P0", "timer without clean-up", r"set(Interval|Timeout)\(", r"clear(Interval|Timeout)\("),
    ("TS-X04", "P0", "endless tween", r"repeatForever\(", r"\.stop\(|stopAll"),
    ("TS-X06", "P1", "anonymous callback cannot be removed", r"addEventListener\([^,]+, *(\(|function)", ""),
    ("APP-J10", "P1", "interval without clear", r"setInterval\(", r"clearInterval\("),
    ("APP-J11", "P2", "object URL not revoked", r"createObjectURL\(", r"revokeObjectURL\("),
    ("APP-J12", "P1", "markup put together from variables", r"innerHTML *\+?= *[^'\"`;]*(\+|\$\{)", ""),
    ("APP-J08", "P1", "host global read", r"window\.(parent|top|opener)\.", ""),
    ("APP-G05", "P1", "scaffold placeholder left", r"(your-app|my-project|PLACEHOLDER|CHANGEME)", ""),
]
NATIVE = [
    ("APP-R01", "P1", "whole file read, then cut", RS, r"fs::read(_to_string)?\(", r"metadata|\.take\("),
    ("APP-R04", "P1", "recursive walk follows links", RS, r"read_dir\(", r"symlink"),
    ("APP-R05", "P1", "path deny-list by text", RS, r"(path|p)\.(starts_with|contains)\( *\"", r"canonicalize"),
    ("APP-R09", "P0", "empty credential accepted", RS, r"(token|secret|password)\.is_empty\(\) *\|\|", ""),
    ("APP-R11", "P0", "file read without a bound on its path", RS, r"File::open\( *&?[a-z_]+ *\)", r"canonicalize|starts_with"),
    ("APP-K15", "P0", "content length drives allocation", RS, r"content_length", r"min\(|MAX_"),
    ("APP-K34", "P1", "stat on a path that may be missing", TS, r"statSync\(", r"existsSync|try"),
    ("RS-04", "P0", "lock held over await", RS, r"\.lock\(\)[^;]*\.await", ""),
    ("RS-05", "P0", "argument used in a path", RS, r"args?\[[0-9]\].*(Path|Command)", ""),
    ("RS-06", "P0", "allocation from input", RS, r"with_capacity\( *[a-z_]+", r"min\(|MAX_"),
    ("RS-08", "P1", "Rc in threaded code", RS, r"Rc<(RefCell|Mutex)", r"^// single-threaded"),
    ("GO-06", "P0", "error result dropped", GO, r"^\s*[a-z_]+\.(Close|Write|Flush)\(\)\s*$", ""),
    ("GO-07", "P1", "Add without Done", GO, r"\.Add\(1\)", r"\.Done\(\)"),
    ("GO-09", "P1", "select without a way out", GO, r"select *\{", r"Done\(\)|default:|time\.After"),
    ("GO-10", "P1", "goroutine without recover", GO, r"go func\(", r"recover\(\)"),
    ("GO-11", "P0", "map written by several goroutines", GO, r"[a-z]+\[[a-z]+\] *= ", r"sync\.|Lock\(\)"),
    ("JAVA-01", "P0", "closeable without try", JV, r"= *new (FileInputStream|FileReader|BufferedReader|Socket)\(", r"try *\("),
    ("JAVA-02", "P0", "executor never shut down", JV, r"Executors\.new", r"shutdown"),
    ("JAVA-03", "P0", "interruption swallowed", JV, r"catch *\( *InterruptedException", r"interrupt\(\)"),
    ("JAVA-05", "P1", "thread local without remove", JV, r"ThreadLocal<", r"\.remove\(\)"),
    ("JAVA-06", "P1", "lock on a shared object", JV, r"synchronized *\( *(this|\"|[A-Z][A-Za-z]+\.class)", ""),
    ("JAVA-07", "P2", "equals without hashCode", JV, r"boolean equals\( *Object", r"hashCode\(\)"),
    ("JAVA-08", "P1", "static mutable state", JV, r"static (List|Map|Set)<[^;]*= *new", r"unmodifiable|Collections\.synchronized"),
    ("CPP-05", "P0", "condition variable guarded by if", CPP, r"if *\([^)]*\) *[a-z_]+\.wait\(", ""),
    ("CPP-06", "P1", "throw in a destructor", CPP, r"~[A-Za-z_]+\(\)[^{]*\{[^}]*throw", r"noexcept\(false\)"),
    ("CPP-08", "P1", "unsigned wrap", CPP, r"\.size\(\) *- *1", r"empty\(\)"),
    ("CPP-09", "P1", "builtin left without a value", CPP, r"^\s*(int|float|double|bool|long) [a-z_]+;", ""),
    ("CPP-13", "P1", "bound with <= size", CPP, r"<= *[a-z_]+\.size\(\)", ""),
]
ENGINE = [
    ("GD05", "P1", "annotation of the old version", GD, r"^(export|onready|tool)( |\()", ""),
    ("GD07", "P1", "class name of the old version", (), r"(^|[^A-Za-z])(Spatial|KinematicBody2?D?|Position2D|Sprite3?)([^A-Za-z0-9]|$)", r"Sprite2D|Node3D"),
    ("GD09", "P1", "old move call", GD, r"move_and_slide\( *[a-z]", ""),
    ("GD10", "P1", "lambda connected", CS, r"\+= *\([^)]*\) *=>", ""),
    ("GD103", "P1", "resource path put together", GD, r"load\( *\"[^\"]*\" *[+%]", ""),
    ("GD105", "P1", "command put together", GD, r"OS\.execute\([^)]*\+", ""),
    ("GD106", "P1", "async error unhandled", CS, r"async void ", ""),
    ("GD111", "P1", "animation tree not active", GD, r"AnimationTree", r"active *= *true"),
    ("GD112", "P1", "linear value as decibel", GD, r"volume_db *= *[a-z_]*(volume|slider)", r"linear_to_db"),
    ("GD115", "P1", "position accumulated by hand", GD, r"position *\+= *velocity", ""),
    ("GD121", "P1", "device id written out", GD, r"get_joy_axis\( *0 *,", ""),
    ("GD132", "P0", "sender of a remote call unchecked", GD, r"@rpc\(.*any_peer", r"get_remote_sender_id"),
    ("GD134", "P1", "remote call without a mode", GD, r"^@rpc$", r"reliable"),
    ("GD135", "P1", "plugin script without tool", GD, r"extends EditorPlugin", r"@tool"),
    ("GD136", "P1", "plugin never removes what it adds", GD, r"add_(custom_type|autoload_singleton|control_to_dock)\(", r"remove_(custom_type|autoload_singleton|control_from_docks)\("),
    ("GD141", "P1", "global random numbers in generation", GD, r"(randi|randf)(_range)?\(", r"RandomNumberGenerator"),
    ("GD151", "P1", "shared resource changed", GD, r"resource\.[a-z_]+ *= ", r"duplicate\("),
    ("GD153", "P0", "stop of time cannot end", GD, r"time_scale *= *0(\.0)?$", r"ignore_time_scale|process_always"),
    ("GD155", "P1", "money as a float", GD, r"(gold|coins|currency) *: *float", ""),
    ("GD163", "P1", "vibration never stopped", GD, r"start_joy_vibration\(", r"stop_joy_vibration\("),
    ("GD164", "P2", "replay by the wall clock", GD, r"replay.*get_ticks_msec", ""),
    ("GD169", "P1", "save without a version", GD, r"store_(var|string)\(", r"version"),
    ("GD185", "P1", "shared material changed", GD, r"material\.(albedo_color|set_shader_parameter)", r"duplicate\("),
    ("GD191", "P1", "markup not escaped", GD, r"(bbcode_text|append_text)\(.*\+", r"escape"),
    ("GD194", "P1", "assert with an effect", GD, r"assert\([a-z_]+\.(erase|push_back|pop|append)", ""),
    ("GD201", "P0", "client decides on payment", GD, r"(payment|purchase)_(success|ok) *= *true", r"is_server\("),
    ("GD204", "P1", "date in local time", GD, r"get_datetime_dict_from_system\( *\)", r"utc"),
    ("GD212", "P1", "up direction is zero", GD, r"up_direction *= *Vector[23]\.ZERO", ""),
    ("GD221", "P1", "death as a flag", GD, r"is_dead *= *true", r"enum|State"),
    ("GD236", "P1", "time scale not restored", GD, r"Engine\.time_scale *= *0\.", r"Engine\.time_scale *= *1"),
    ("GD271", "P2", "cutscene leaves input on", GD, r"play_cutscene\(", r"set_process_input\(false\)"),
    ("GD274", "P1", "version written out", GD, r"version *== *\"[0-9]", ""),
    ("GD286", "P1", "shuffle without a seed", GD, r"\.shuffle\(\)", ""),
    ("GD304", "P1", "just pressed in the physics step", GD, r"_physics_process[^\n]*is_action_just_pressed", ""),
    ("GD315", "P1", "use after free", GD, r"queue_free\(\) *;? *[a-z_]+\.", ""),
    ("GD316", "P0", "plain random numbers for secrets", GD, r"(token|secret|nonce) *= *.*rand", r"Crypto"),
    ("GD321", "P2", "request without retry", GD, r"HTTPRequest", r"retry|attempt"),
    ("GD322", "P1", "parse failure unchecked", GD, r"JSON\.parse_string\(", r"== null|is_empty|!= OK"),
    ("GD326", "P0", "key written out", GD, r"(api_key|token) *= *\"[A-Za-z0-9]{12,}\"", r"OS\.get_environment"),
    ("GD327", "P1", "password written out", GD, r"open_encrypted_with_pass\([^)]*\"[^\"]+\" *\)", ""),
    ("GD342", "P0", "fast hash for a password", GD, r"password.*\.(md5_text|sha256_text)\(", r"pbkdf|bcrypt"),
    ("GD344", "P1", "retry without back-off", GD, r"retry *\+= *1", r"pow\(|backoff|jitter"),
    ("GD345", "P1", "outer call without timeout", GD, r"\.request\(", r"timeout"),
    ("GD45", "P0", "unsafe deserialising", (), r"(bytes_to_var_with_objects|str_to_var)\(", ""),
    ("GD72", "P2", "signal emitted by name", GD, r"emit_signal\( *\"", ""),
    ("GD93", "P1", "floats compared for equality", GD, r"== *[0-9]+\.[0-9]+", ""),
    ("GD94", "P1", "distance by root", GD, r"distance_to\([^)]*\) *[<>]", ""),
    ("GD98", "P2", "self-assignment", GD, r"^\s*self\.([a-z_]+) *= *self\.[a-z_]+$", ""),
    ("GD82", "P1", "secret constant", GD, r"const [A-Z_]*(SECRET|PASSWORD)[A-Z_]* *=", ""),
    ("GDS01", "P1", "old hint", SH, r"hint_(albedo|aniso|black|white)([^_a-z]|$)", ""),
    ("GDS03", "P1", "old global", SH, r"(WORLD_MATRIX|CAMERA_MATRIX|SCREEN_TEXTURE)", ""),
    ("GDS05", "P1", "colour texture without its hint", SH, r"uniform sampler2D [a-z_]*(albedo|color|diffuse)", r"source_color"),
    ("GDS07", "P2", "discard", SH, r"discard;", ""),
    ("GDS08", "P2", "no precision given", SH, r"^uniform (float|vec[234]) ", r"(high|medium|low)p"),
    ("CC-15", "P1", "empty clean-up", TS, r"onDestroy\(\) *\{ *\}", ""),
    ("CC-18", "P2", "label text without cache mode", TS, r"\.string *= *", r"cacheMode"),
    ("CC-20", "P1", "old API", TS, r"cc\.(find|loader|director)\.", ""),
]

RULES = [Rule(i, lv, t, p, TS, absent=a) for i, lv, t, p, a in SCRIPT]
RULES += [Rule(i, lv, t, p, langs, absent=a) for i, lv, t, langs, p, a in NATIVE]
RULES += [Rule(i, lv, t, p, langs, absent=a, first_only=True, scene="p-godot") for i, lv, t, langs, p, a in ENGINE]
