"""Schemas of the engine's tables; nothing is inferred."""

from __future__ import annotations

LIGHTCURVE = "star_id int, t double, flux double, flux_err double"
PLANET_TRUTH = "star_id int, has_planet int, period double, t0 double, duration double, depth double"
BLS_RESULT = "star_id int, period double, t0 double, duration double, depth double, sde double"
SEQUENCE = "name string, seq string"
WINDOWS = "name string, start int, stop int"
READ_TRUTH = "read string, true_origin int, n_subs int, n_indels int"
ALIGNMENT = "read string, score int, query_end int, target_end int"
CLIMATE = "day int, lat_i int, lon_j int, tasmax float, tasmin float, tas float, pr float"
TRAJECTORY = "frame int, atom int, x float, y float, z float"
TOPOLOGY = "atom int, name string, type int, resid int"
ROLES = "atom int, role string"
CATALOG = "idx int, object_id long, ra double, dec double"
PROFILE = "read_ops double, read double, open_files double, rss double, vms double, walltime double, count double, tick int, file_type string, sorting_type string"
EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
