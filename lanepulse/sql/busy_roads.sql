-- The :k roads with the most vehicles inside [:start_hour, :end_hour)
SELECT Road_EN, District, sum(volume) AS total_volume, sum(occupancy) AS total_occupancy
FROM {obs}
WHERE hour >= :start_hour AND hour < :end_hour
  AND Road_EN IS NOT NULL
GROUP BY ALL
ORDER BY total_volume DESC, Road_EN NULLS FIRST, District NULLS FIRST
LIMIT :k
