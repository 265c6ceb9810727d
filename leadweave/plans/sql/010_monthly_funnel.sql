-- Matured leads by the month they were made in.
WITH matured AS (
  SELECT *, date_format(created_at, 'yyyy-MM') AS month FROM IDENTIFIER(:facts) WHERE created_at <= :matured_until
)
SELECT
  month,
  int(count(*)) AS leads,
  int(count_if(consent_to_contact)) AS consented,
  int(sum(contacted)) AS contacted,
  int(sum(qualified)) AS qualified,
  int(sum(booked)) AS booked,
  int(sum(attended)) AS attended,
  int(sum(won)) AS won,
  round(avg(booked) * 1e6, 0) / 1e6 AS booking_rate,
  round(avg(attended) * 1e6, 0) / 1e6 AS attendance_rate,
  round(avg(won) * 1e6, 0) / 1e6 AS win_rate,
  round(double(sum(CAST(response_minutes AS decimal(18, 2)))) / count(response_minutes) * 1e2, 0) / 1e2 AS average_response_minutes,
  round(median(response_minutes) * 1e2, 0) / 1e2 AS median_response_minutes
FROM matured
GROUP BY month
