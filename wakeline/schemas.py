"""Declared schemas of the logical tables, as DDL text for ``spark.read.schema``."""


TRACKS = (
    "id string, vessel_id string, recorded_at timestamp, lon double, lat double, speed_knots decimal(5,2), "
    "course_degrees decimal(5,2), heading_degrees decimal(5,2), navigational_status string, source string, "
    "source_record_id string, ingestion_batch_id string, created_at timestamp"
)
VESSELS = (
    "id string, mmsi string, imo string, vessel_name string, vessel_type string, flag_country_code string, "
    "deadweight_tonnage decimal(12,2), source string, metadata string"
)
VESSEL_STATIC_HISTORY = (
    "vessel_id string, recorded_at timestamp, draft_meters decimal(4,2), destination string, eta timestamp, "
    "dimension_length decimal(6,2), dimension_beam decimal(6,2)"
)
SCENES = (
    "id string, source_provider string, external_scene_id string, captured_at timestamp, ingested_at timestamp, "
    "footprint array<struct<lon:double,lat:double>>, cloud_cover_percentage decimal(5,2), wind_speed decimal(5,2), "
    "wind_direction decimal(5,2), storage_uri string, sha256 string, processing_status string, source_metadata string"
)
SPILLS = (
    "id string, scene_id string, detected_at timestamp, spill_polygon array<array<struct<lon:double,lat:double>>>, "
    "area_sq_km decimal(10,3), detection_model_name string, detection_model_version string, "
    "confidence_score decimal(4,3), processing_run_id string, status string, reviewed_by string, review_notes string"
)
SAR_TARGETS = (
    "id string, scene_id string, detected_at timestamp, lon double, lat double, intensity decimal(8,2), "
    "confidence decimal(4,3), patch_uri string, source string"
)
TARGET_CORRELATIONS = (
    "id string, sar_target_id string, vessel_id string, match_status string, "
    "haversine_distance_m decimal(10,2), anomaly_flags string"
)
AIS_GAPS = (
    "id string, vessel_id string, gap_start timestamp, gap_end timestamp, gap_duration_min decimal(6,2), "
    "last_lon double, last_lat double, next_lon double, next_lat double, center_lon double, center_lat double, "
    "distance_from_coast_nm decimal(6,2), is_open_water boolean"
)
ENVIRONMENTAL_DATA = (
    "source string, variable string, valid_time timestamp, lon double, lat double, value decimal(8,4)"
)
DRIFT_RUNS = (
    "id string, scene_id string, vessel_id string, spill_id string, simulation_version string, "
    "model_parameters string, run_fingerprint string, started_at timestamp, completed_at timestamp, status string, "
    "output_storage_uri string, output_sha256 string, result_summary string, error_message string"
)
CPA_EVENTS = (
    "drift_run_id string, vessel_id string, min_distance_m decimal(10,2), cpa_timestamp timestamp, "
    "tcpa_seconds decimal(10,2), vessel_lon double, vessel_lat double, slick_lon double, slick_lat double"
)
ATTRIBUTION_SCORES = (
    "drift_run_id string, scoring_version string, cpa_score decimal(4,3), dark_vessel_score decimal(4,3), "
    "loitering_score decimal(4,3), capacity_multiplier decimal(4,3), draft_change_score decimal(4,3), "
    "permutation_p_value decimal(6,5), stability_index decimal(4,3), total_score decimal(5,2), verdict string, "
    "explanation string, calculated_at timestamp"
)
AUDIT_LOG = (
    "id string, occurred_at timestamp, actor_type string, actor_id string, action string, entity_type string, "
    "entity_id string, request_id string, ip_address string, before_data string, after_data string, metadata string, "
    "hash_chain_previous string, event_hash string"
)
DOSSIERS = (
    "id string, scene_id string, spill_id string, dossier_version int, generated_at timestamp, generated_by string, "
    "storage_uri string, sha256 string, evidence_snapshot string, status string, supersedes_dossier_id string"
)
ALERTS = (
    "id string, incident_id string, station_id string, station_name string, station_distance_km double, "
    "severity string, confidence double, top_suspect string, interception_count int, nearest_vessels array<string>, "
    "eta_hours double, sms_status string, sms_reason string, created_at timestamp, acked_by string, acked_at timestamp"
)
STATIONS = (
    "id string, name string, region string, lat double, lon double, phone string, response_radius_km double, "
    "command_centre string"
)
INTERCEPTORS = ("mmsi string, name string, type string, home_port string, lat double, lon double")

# Raw AIS rows arrive as text and are typed by the cleaning operators.
AIS_CSV = (
    "MMSI string, LON string, LAT string, UTC string, SOG string, COG string, HEADING string, STATUS_DESC string"
)
PRESENCE = (
    "callsign string, dataset string, date string, entryTimestamp string, exitTimestamp string, "
    "firstTransmissionDate string, flag string, geartype string, hours double, imo string, "
    "lastTransmissionDate string, lat double, lon double, mmsi string, shipName string, vesselId string, "
    "vesselType string"
)
AIS_MESSAGE = (
    "MessageType string, MetaData struct<MMSI:string,ShipName:string,IMO:string,ShipType:string>, "
    "Message struct<PositionReport:struct<Latitude:double,Longitude:double,Sog:double,TrueHeading:int>,"
    "ShipStaticData:struct<ImoNumber:string,Name:string,Type:string,Dimension:struct<A:int,B:int,C:int,D:int>>>, "
    "received_at timestamp, number bigint"
)
