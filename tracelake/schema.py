"""Schemas of the tables."""

ELECTRODE = "sensor int, label string, reference string, unit string, status string, type string, iscale double, rscale double"
SIGNAL = "sensor int, sample bigint, epoch bigint, value int"
EPOCHS = "epoch bigint, length bigint, data binary"
TRIGGER = "ordinal bigint, sample bigint, code string"
CHUNK = "id string, label string, path string, fpos bigint, payload bigint, size bigint"
EMBEDDED = "label string, size bigint, content binary"
HEADER = (
    "kind string, version_major int, version_minor int, start_time timestamp, sampling_frequency double, epoch_length bigint, sample_count bigint, epochs bigint, channels int, "
    "row_order array<int>, history string, hospital string, test_name string, test_serial string, physician string, technician string, machine_make string, machine_model string, "
    "machine_sn string, subject_name string, subject_id string, subject_address string, subject_phone string, subject_sex string, subject_handedness string, subject_dob timestamp, comment string"
)
DESCRIPTOR = "struct<name:string,unit:string,type:string,is_array:boolean,data:array<string>>"
EVENT = (
    "ordinal bigint, kind string, class string, visible_id int, name string, user_visible_name string, type int, state int, original int, duration double, duration_offset double, stamp timestamp, "
    f"descriptors array<{DESCRIPTOR}>, channel_active string, channel_reference string, description string, amplitude_peak float, show_amplitude int, show_duration int"
)
TABLES = {"signal": SIGNAL, "epochs": EPOCHS, "header": HEADER, "electrodes": ELECTRODE, "triggers": TRIGGER, "chunks": CHUNK, "embedded": EMBEDDED}
