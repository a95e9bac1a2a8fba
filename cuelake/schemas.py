"""Schemas of the documents the readers accept."""

WORD = "struct<word:string,start_ms:bigint,end_ms:bigint,probability:double>"
TRANSCRIPT = (
    "project_id string, language string, engine struct<provider:string,model:string>, duration_seconds double, "
    "has_word_timing boolean, cues array<struct<id:bigint,start_ms:bigint,end_ms:bigint,text:string,"
    f"confidence:double,no_speech_prob:double,words:array<{WORD}>>>"
)
WHISPER = (
    "project_id string, language string, duration double, segments array<struct<id:bigint,start:double,end:double,text:string,"
    "avg_logprob:double,no_speech_prob:double,"
    "words:array<struct<word:string,start:double,end:double,probability:double>>>>"
)
CAPTION = (
    "project_id string, language string, source_language string, script_class string, glossary_id string, "
    "cues array<struct<id:bigint,start_ms:bigint,end_ms:bigint,source_text:string,target_text:string,"
    "flags:array<string>,context_note:string,lines:array<string>,back_translation:string>>"
)
GLOSSARY = (
    "glossary_id string, source_language string, terms array<struct<source:string,"
    "targets:map<string,struct<rendering:string,aliases:array<string>>>,must_appear:boolean>>"
)
EVENT = "event_id string, project_id string, event string, actor string, time timestamp, details string"
ARTIFACT_MANIFEST = (
    "project_id string, artifacts array<struct<artifact_id:string,type:string,language:string,stage:string,"
    "version:int,path:string,sha256:string,size_bytes:bigint,created_at:timestamp,created_by:string,"
    "source_artifact_ids:array<string>,provenance:map<string,string>,rights_status:string,"
    "validation_status:string,supersedes:string,frozen:boolean>>"
)
APPROVAL = (
    "approval_id string, project_id string, gate string, language string, approver string, decision string, "
    "artifact_hashes array<string>, scope string, created_at timestamp, expires_at timestamp, "
    "invalidated_at timestamp, invalidation_reason string"
)
TRACK = (
    "struct<stage:string,status:string,dub_enabled:boolean,auto_translate:boolean,skip_translation:boolean,"
    "updated_at:timestamp,notes:string>"
)
STATE = (
    "project_id string, current_state string, previous_state string, source_language string, "
    f"target_languages array<string>, language_tracks map<string,{TRACK}>, active_artifacts map<string,string>"
)
STAGE = "status:string,started_at:timestamp,finished_at:timestamp,artifact:string,error:string"
RUN_STATUS = (
    f"video_id string, url string, stages map<string,struct<{STAGE},per_language:map<string,struct<{STAGE}>>>>, "
    "_corrupt_record string"
)
PLAYLIST = (
    "id string, title string, entries array<struct<id:string,url:string,title:string,channel:string,duration:double>>"
)
BATCH_LIST = "videos array<struct<id:string,url:string,overrides:map<string,string>>>"
PROBE = (
    "project_id string, language string, has_video boolean, has_audio boolean, container_ms bigint, dub_ms bigint"
)
FINDING = (
    "project_id string, report_type string, severity string, category string, summary string, language string, "
    "cue_id bigint, timestamp_ms bigint, evidence string"
)
