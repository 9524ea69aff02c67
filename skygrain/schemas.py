"""Schemas of the engine's tables."""

GRANULE = "granule_id string, product string, ts timestamp, crs string, height int, width int, x0 double, y0 double, dx double, dy double, aot array<float>, unc array<float>"
STATION = "id string, name string, latitude double, longitude double, elevation double"
MONITORING_STATION = "Name string, Latitude double, Longitude double"
LISTING = "product string, part_ts timestamp, name string, size long, url string"
LEDGER = "product string, part_ts timestamp, name string, status string, bytes long, at timestamp, reason string"
OBSERVATION = "station_id int, ts timestamp, threshold float, aot double"
POLYGON_EDGE = "poly_id int, ring_id int, edge_id int, x1 double, y1 double, x2 double, y2 double"
TREE_NODE = "kind string, name string, shape array<bigint>, dtype string"
