"""DataFrame -> DataFrame operators: joins, aggregations, splits, decision reports, routers."""
