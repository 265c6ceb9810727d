-- Matured leads by campaign and channel, of those with enough of them.
SELECT *
FROM (
  SELECT
    campaign,
    channel,
    int(count(*)) AS leads,
    int(sum(booked)) AS booked,
    round(avg(booked) * 1e6, 0) / 1e6 AS booking_rate,
    round(median(response_minutes) * 1e2, 0) / 1e2 AS median_response_minutes,
    round(double(sum(CAST(estimated_value AS decimal(18, 2)))) * 1e2, 0) / 1e2 AS pipeline_value
  FROM IDENTIFIER(:facts)
  WHERE created_at <= :matured_until
  GROUP BY campaign, channel
)
WHERE leads >= :least_leads
