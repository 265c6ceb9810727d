-- Leads whose window is open, that have been watched for long enough and haven't booked.
SELECT
  lead_id, created_at, channel, campaign, service_type, region, consent_to_contact, is_returning, response_minutes,
  follow_up_count, estimated_value, created_weekday, created_hour
FROM IDENTIFIER(:facts)
WHERE booked = 0 AND created_at > :matured_until AND observation_complete_at <= :as_of
