-- The :k most congested roads inside [:start_hour, :end_hour)
WITH roads AS (
  SELECT Road_EN, District,
         sum(volume) AS total_volume,
         avg(occupancy) AS avg_occupancy,
         avg(speed) AS avg_speed,
         count(*) AS observation_count,
         count_if(occupancy > :severe_occupancy AND speed < :severe_speed) AS severe_congestion_count,
         count_if(occupancy > :moderate_occupancy AND speed < :moderate_speed) AS moderate_congestion_count
  FROM {obs}
  WHERE hour >= :start_hour AND hour < :end_hour
    AND Road_EN IS NOT NULL
  GROUP BY ALL
)
SELECT *,
       avg_occupancy * 0.4D + (100 - avg_speed) * 0.3D
         + try_divide(severe_congestion_count, observation_count) * 100 * 0.3D AS congestion_score
FROM roads
ORDER BY congestion_score DESC, Road_EN NULLS FIRST, District NULLS FIRST
LIMIT :k
