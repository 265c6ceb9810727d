-- Matured leads by channel.
SELECT
  channel,
  int(count(*)) AS leads,
  int(sum(booked)) AS booked,
  round(avg(booked) * 1e6, 0) / 1e6 AS booking_rate,
  round(avg(attended) * 1e6, 0) / 1e6 AS attendance_rate,
  round(avg(won) * 1e6, 0) / 1e6 AS win_rate,
  round(median(response_minutes) * 1e2, 0) / 1e2 AS median_response_minutes,
  round(avg(follow_up_count) * 1e2, 0) / 1e2 AS average_follow_ups,
  round(double(sum(CAST(estimated_value AS decimal(18, 2)))) * 1e2, 0) / 1e2 AS pipeline_value
FROM IDENTIFIER(:facts)
WHERE created_at <= :matured_until
GROUP BY channel
