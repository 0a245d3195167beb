-- The :k roads with the highest occupancy per vehicle, above a percentage
SELECT Road_EN, District, sum(volume) AS total_volume,
       try_divide(sum(occupancy), sum(volume)) * 100 AS avg_occupancy_pct
FROM {obs}
WHERE Road_EN IS NOT NULL AND occupancy IS NOT NULL AND volume IS NOT NULL
GROUP BY ALL
HAVING avg_occupancy_pct > :above
ORDER BY avg_occupancy_pct DESC, Road_EN NULLS FIRST, District NULLS FIRST
LIMIT :k
