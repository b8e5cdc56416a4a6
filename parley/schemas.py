"""Schemas of the files and tables. JSON files keep their camel-case names; tables use snake case."""

MESSAGES = "array<struct<id:string,role:string,markdown:string,createdAt:string>>"
PARTICIPANTS = "array<struct<id:string,role:string,name:string>>"
BUNDLE = (f"platform string, sourceId string, url string, title string, extractedAt string, sourceUpdatedAt string, "
          f"participants {PARTICIPANTS}, messages {MESSAGES}, meta string")
INGEST = (f"bundle struct<platform:string,sourceId:string,url:string,title:string,extractedAt:string,sourceUpdatedAt:string,"
          f"participants:{PARTICIPANTS},messages:{MESSAGES},meta:string>, rawCapture string, "
          "client struct<extensionVersion:string,browser:string>")

CONVERSATIONS = ("platform string, source_id string, title string, url string, latest_revision string, "
                 "latest_source_updated_at string, created_at string, updated_at string, message_count bigint, "
                 "file_bundle_json string, file_markdown string, file_raw_capture string")
REVISIONS = ("platform string, source_id string, revision string, extracted_at string, source_updated_at string, "
             "created_at string")
INDEX = ("platform string, source_id string, title string, url string, last_seen_at string, "
         "latest_discovery_fingerprint string, latest_source_updated_at string, latest_source_updated_label string, "
         "discovery_state string, export_state string, latest_export_revision string, latest_export_version string")
QUEUE = ("pos bigint, key string, platform string, source_id string, url string, title string, source_updated_at string, "
         "source_updated_label string, revision_fingerprint string, kind string, priority string, worker_id string, "
         "status string, attempts int, last_error string, error_code string, skip_reason string, result_revision string, "
         "discovered_at string, updated_at string")
ARTIFACTS = ("platform string, source_id string, revision string, pos bigint, markdown_download_id bigint, "
             "bundle_download_id bigint, markdown_filename string, bundle_filename string, exported_at string, "
             "local_status string, is_latest boolean")
LOGS = ("id string, timestamp string, level string, scope string, message string, code string, trace_id string, "
        "platform string, source_id string, worker_id string, details string")
DISCOVERY = ("seq bigint, platform string, source_id string, url string, title string, source_updated_at string, "
             "source_updated_label string, revision_fingerprint string")

# JSON name to table name of a bundle.
BUNDLE_NAMES = {"sourceId": "source_id", "extractedAt": "extracted_at", "sourceUpdatedAt": "source_updated_at"}
