"""Schemas of the code index, of candidates and findings, and of events, as DDL strings, which readers take."""

FILES = "file_id long, path string, content_hash string"
FUNCTIONS = "function_id long, name string, signature string, return_type string, file_id long, start_line int, end_line int, is_static boolean, linkage string, body string"
STRUCTS = "struct_id long, name string, file_id long, start_line int, end_line int, definition string"
CALLS = "caller_function_id long, callee_name string, callee_function_id long, file_id long, line int, column int"
GLOBALS = "global_id long, name string, file_id long, start_line int, end_line int, is_static boolean, is_extern boolean, definition string"
REFERENCES = "global_id long, variable_name string, function_id long, file_id long, line int, context string, access_type string"
CANDIDATE = "file string, line int, function string, description string, vuln_type string, related_functions array<string>, metadata map<string,string>"
FINDING = "scan_id string, idx int, file string, line int, function string, vuln_type string, severity string, description string, ai_verdict string, confirmed boolean, user_verdict string, ticket_submitted boolean, call_chain array<string>"
EVENT = "scan_id string, seq long, timestamp timestamp, phase string, message string, candidate_index int"

#: What makes two candidates the same one.
CANDIDATE_KEY = ("file", "line", "function", "vuln_type")
