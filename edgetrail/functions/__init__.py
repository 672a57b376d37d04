from .identity import (
    content_type,
    device_class,
    device_id,
    ipv4_number,
    normalize_ip,
    region_from_edge,
    region_from_ip,
    request_id,
    resolve_label,
    safe_id,
    segment_parts,
    session_id,
    token_id,
)
from .playlists import master_variants, playlist_fields, playlist_lines, stream_attributes
from .text import duration_label, first_tag, resolutions, sanitize_tag, slugify, split_list
from .urls import (
    display_name,
    form_decode,
    hls_path_of,
    kind_of_path,
    path_content_id,
    path_filename,
    path_title,
    percent_decode,
    referrer,
    referrer_host,
    request_content_id,
    request_kind,
    resource_type,
    strip_query,
    url_domain,
    watch_content_id,
)
from .values import filled, is_known, known, parse_flag, parse_positive_int, present, to_double, to_long, truthy

__all__ = [name for name in dir() if not name.startswith("_")]
